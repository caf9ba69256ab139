"""Period predicates (section 2.2 of the survey).

Request parameters are resolved once, on the driver, into two literal bounds;
the row filter is always a half-open range ``lo <= c < hi`` on the raw column.
A range on the raw column is pushed into the Parquet scan (row-group
skipping), while ``date_trunc(c) = x`` or ``to_date(c) = x`` is not.
"""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rinse import config as C
from rinse.config import as_date

_MONTH = re.compile(C.MONTH_PATTERN)
_DAY = re.compile(C.DAY_PATTERN)
ONE_DAY = dt.timedelta(days=1)


def _month_bounds(year: int, month: int) -> tuple[dt.datetime, dt.datetime]:
    """First of ``month`` and of the month after; month 0 and 13 roll like Date.UTC."""
    idx = year * 12 + (month - 1)
    start = dt.datetime(idx // 12, idx % 12 + 1, 1)
    nxt = idx + 1
    return start, dt.datetime(nxt // 12, nxt % 12 + 1, 1)


def _as_dt(value) -> dt.datetime:
    if isinstance(value, dt.datetime):
        return value
    if isinstance(value, str) and len(value) > 10:
        return dt.datetime.fromisoformat(value)
    d = as_date(value)
    return dt.datetime(d.year, d.month, d.day)


def resolve_range(date=None, from_=None, to=None, month=None, as_of=None):
    """Bounds of a report period: month wins, then from/to, then date, else the day of as_of."""
    as_of = _as_dt(as_of or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None))
    if month and _MONTH.match(str(month)):
        y, m = map(int, str(month).split("-"))
        return _month_bounds(y, m)
    if from_:
        start = dt.datetime.fromisoformat(str(from_))   # a bad 'from' is an error
        if to:
            return start, dt.datetime.fromisoformat(str(to)) + ONE_DAY
        return start, start + ONE_DAY
    d = str(date) if date and _DAY.match(str(date)) else as_of.date().isoformat()
    start = dt.datetime.fromisoformat(d)
    return start, start + ONE_DAY


def ts_lit(value: dt.datetime) -> Column:
    """A timestamp_ntz literal (no session time-zone shift against ntz columns)."""
    return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")


def in_range(col: str | Column, lo=None, hi=None) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    cond = F.lit(True)
    if lo is not None:
        cond = cond & (c >= ts_lit(lo))
    if hi is not None:
        cond = cond & (c < ts_lit(hi))
    return cond


def period_filter(df: DataFrame, ts: str, date=None, from_=None, to=None, month=None,
                  as_of=None) -> DataFrame:
    lo, hi = resolve_range(date=date, from_=from_, to=to, month=month, as_of=as_of)
    return df.filter(in_range(ts, lo, hi))


def day_filter(df: DataFrame, ts: str, day) -> DataFrame:
    lo = _as_dt(day)
    return df.filter(in_range(ts, lo, lo + ONE_DAY))


def rolling_bounds(period: str, as_of) -> tuple[dt.datetime, dt.datetime | None]:
    """week = last 7 x 24 h, month = last 30 x 24 h (no upper bound); else the day of as_of."""
    now = _as_dt(as_of)
    if period == "week":
        return now - dt.timedelta(days=7), None
    if period == "month":
        return now - dt.timedelta(days=30), None
    start = dt.datetime(now.year, now.month, now.day)
    return start, start + ONE_DAY


def rolling_filter(df: DataFrame, ts: str, period: str, as_of) -> DataFrame:
    lo, hi = rolling_bounds(period, as_of)
    return df.filter(in_range(ts, lo, hi))


def month_bounds(month, as_of) -> tuple[dt.datetime, dt.datetime]:
    """Calendar month of 'YYYY-MM' (first 7 characters); invalid -> month of as_of."""
    m = str(month or "")[:7]
    if not _MONTH.match(m):
        m = _as_dt(as_of).strftime("%Y-%m")
    y, mm = map(int, m.split("-"))
    return _month_bounds(y, mm)


def month_filter(df: DataFrame, ts: str, month, as_of) -> DataFrame:
    lo, hi = month_bounds(month, as_of)
    return df.filter(in_range(ts, lo, hi))


def open_range_filter(df: DataFrame, ts: str, from_=None, to=None) -> DataFrame:
    lo = dt.datetime.fromisoformat(str(from_)) if from_ else None
    hi = dt.datetime.fromisoformat(str(to)[:10]) + ONE_DAY if to else None
    return df.filter(in_range(ts, lo, hi))


def service_filter(services: DataFrame, service_id=None, keyword=None,
                   name_col: str = "name", id_col: str = "id") -> DataFrame:
    """By id; else name contains keyword (case-insensitive, % and _ stay wildcards);
    else name contains one of the full-service words."""
    if service_id is not None:
        return services.filter(F.col(id_col) == F.lit(service_id))
    if keyword:
        return services.filter(F.col(name_col).ilike(f"%{keyword}%"))
    cond = None
    for w in C.FULL_SERVICE_WORDS:
        c = F.col(name_col).ilike(f"%{w}%")
        cond = c if cond is None else cond | c
    return services.filter(cond)


def nonblank_filter(df: DataFrame, col: str) -> DataFrame:
    return df.filter(F.coalesce(F.col(col), F.lit("")) != "")
