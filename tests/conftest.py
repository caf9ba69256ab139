from __future__ import annotations

import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402

from rinse.session import SESSION_DEFAULTS  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    b = SparkSession.builder.master("local[*]").appName("rinse-tests") \
        .config("spark.sql.shuffle.partitions", "8")
    for k, v in SESSION_DEFAULTS.items():
        b = b.config(k, v)
    s = b.getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    if not s.sparkContext.getCheckpointDir():
        s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="rinse-test-ckpt-"))
    yield s


SMALL = "/root/testdata/sf0.001"
