from __future__ import annotations

import duckdb
import pytest

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents() -> list[tuple[int, str]]:
    return duckdb.sql(f"SELECT doc_id, text FROM '{SMALL}/documents.parquet'").fetchall()


@pytest.fixture(scope="session")
def odd(spark):
    """Rows with NULLs, empty and long texts, ties and repeats, and clashing extra columns."""
    long = " ".join(f"w{i % 97}" for i in range(4000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "a b c"), (5, "A  b\tC"), (6, long), (7, long), (8, long + " tail"), (9, "x" * 5000),
            (10, "mit license mit license"), (11, "Licensed under CC BY-NC 4.0."), (12, "same line\nsame line\n\nsame line")]
    return spark.createDataFrame([(i, t, None, 0, "x") for i, t in rows],
                                 "doc_id bigint, text string, n_words string, row int, cls string")
