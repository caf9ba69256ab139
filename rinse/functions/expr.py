"""Scalar column functions (section 2.9 of the survey).

All are built-in Spark expressions, so they stay inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rinse import config as C


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def plate(col) -> Column:
    """Upper case, strip whitespace and hyphens; NULL -> ''."""
    return F.coalesce(F.regexp_replace(F.upper(_c(col)), r"[\s-]", ""), F.lit(""))


def phone_digits(col) -> Column:
    """Digits only; NULL -> ''."""
    return F.coalesce(F.regexp_replace(_c(col), r"\D+", ""), F.lit(""))


def reg(col) -> Column:
    """UPPER(TRIM(x)): trims spaces only, keeps inner separators."""
    return F.upper(F.trim(_c(col)))


def regkey(col) -> Column:
    """COALESCE(NULLIF(UPPER(x), ''), ''): NULL and blank compare equal."""
    return F.coalesce(F.nullif(F.upper(_c(col)), F.lit("")), F.lit(""))


def plate_valid(col, strict: bool = False) -> Column:
    return _c(col).rlike(C.PLATE_PATTERN_STRICT if strict else C.PLATE_PATTERN)


def day(col) -> Column:
    return F.to_date(_c(col))


def month_start(col) -> Column:
    return F.trunc(F.to_date(_c(col)), "MM")


def to_month(col, as_of) -> Column:
    """Parse 'YYYY-MM' to the first of the month; unparsable -> month of ``as_of``."""
    parsed = F.to_date(F.try_to_timestamp(_c(col), F.lit("yyyy-MM")))
    fallback = F.trunc(F.lit(C.as_date(as_of)), "MM")
    return F.coalesce(parsed, fallback)


def to_char_minute(col) -> Column:
    """to_char(ts, 'YYYY-MM-DD HH24:MI')."""
    return F.date_format(_c(col), "yyyy-MM-dd HH:mm")


def default(col, value) -> Column:
    return F.coalesce(_c(col), F.lit(value))


def price_case(label_col, rules: dict | None = None, other=C.SEED_PRICE_OTHER) -> Column:
    """CASE label WHEN ... THEN price ... ELSE other END."""
    rules = C.SEED_PRICE_BY_CAR_TYPE if rules is None else rules
    expr = None
    for label, price in rules.items():
        cond = _c(label_col) == F.lit(label)
        expr = F.when(cond, F.lit(price)) if expr is None else expr.when(cond, F.lit(price))
    return F.lit(other) if expr is None else expr.otherwise(F.lit(other))


def pct_of(part, whole, scale: int = 1) -> Column:
    """part / whole * 100 rounded to ``scale`` decimals; 0 when whole is 0."""
    ratio = _c(part).cast("double") / _c(whole).cast("double") * 100
    return F.when(_c(whole) != 0, F.round(ratio, scale)).otherwise(F.lit(0.0))


def change_pct(current, previous, scale: int = 4) -> Column:
    """(current - previous) / |previous| * 100; NULL when previous is 0."""
    cur, prev = _c(current).cast("double"), _c(previous).cast("double")
    return F.when(prev != 0, F.round((cur - prev) / F.abs(prev) * 100, scale))


def concat_note(note, reason) -> Column:
    """COALESCE(note,'') || CASE WHEN reason IS NOT NULL THEN prefix || reason ELSE '' END."""
    tail = F.when(_c(reason).isNotNull(), F.concat(F.lit(C.REVOCATION_PREFIX), _c(reason))) \
        .otherwise(F.lit(""))
    return F.concat(F.coalesce(_c(note), F.lit("")), tail)


def draw_uniform(key, seed: str) -> Column:
    """Repeatable uniform number in [0, 1): first 8 hex digits of md5(key || seed) / 2^32."""
    h = F.substring(F.md5(F.concat(_c(key).cast("string"), F.lit(seed))), 1, 8)
    return F.conv(h, 16, 10).cast("double") / F.lit(4294967296.0)
