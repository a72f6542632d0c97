"""Casts, dates and arithmetic that keep the meaning they have in the SQL the queries are held against."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Dates that stand for none.
SENTINEL_DATES = ("00000000", "0001-01-01", "1900-01-01", "1970-01-01", "9999-12-30", "9999-12-31")


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def to_double(x) -> Column:
    return F.regexp_replace(_c(x).cast("string"), ",", "").try_cast("double")


def to_long(x) -> Column:
    """Rounds as a cast from a fractional value does in the other engine; null if it is no number."""
    return F.round(to_double(x)).try_cast("bigint")


def to_day(x) -> Column:
    """ISO, then month/day/year, then yyyymmdd; sentinels and everything else are null."""
    s = F.trim(_c(x).cast("string"))
    iso = F.when(s.rlike(r"^\d{4}-\d{1,2}-\d{1,2}"), F.substring(s, 1, 10).try_cast("date"))
    us = F.when(s.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), F.try_to_date(s, "M/d/yyyy"))
    plain = F.when(s.rlike(r"^\d{8}$"), F.try_to_date(s, "yyyyMMdd"))
    return F.when(~s.isin(*SENTINEL_DATES), F.coalesce(iso, us, plain))


def safe_ratio(a, b) -> Column:
    """Null where the divisor is zero or null."""
    return F.try_divide(_c(a), _c(b))


def yes(x) -> Column:
    s = F.upper(F.trim(_c(x).cast("string")))
    return F.when(s.isin("Y", "YES", "TRUE", "1"), True).when(s.isin("N", "NO", "FALSE", "0"), False)


def evidence_json(*cols) -> Column:
    """A JSON object that keeps its null fields."""
    return F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})


def flag_id(*cols) -> Column:
    """A non-negative 63-bit id from the values."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 1)
