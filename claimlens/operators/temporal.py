"""Joins over time: payments after an event, look-backs and overlaps. All have an equality on the entity, so Spark
shuffles on it and tests the range on the matches; no nested loop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def month_of(c) -> Column:
    """First day of the month, as a date."""
    return F.trunc(F.to_date(c), "MM")


def months_between(a, b) -> Column:
    """Calendar months from a to b, whatever the days (Jan 31 to Feb 1 is 1)."""
    a, b = (F.to_date(x) for x in (a, b))
    return (F.year(b) - F.year(a)) * 12 + F.month(b) - F.month(a)


def add_months(c, n: int) -> Column:
    return F.add_months(F.to_date(c), n)


def month_window_join(facts: DataFrame, events: DataFrame, key: str, month: str = "month_start", start: str = "event_dt", end: str = "window_end") -> DataFrame:
    """Facts of a month after the event's month and, where the window has an end, before the end's month: half open,
    at month grain. Facts are expected pre-aggregated to key and month."""
    f, e = facts.alias("f"), events.alias("e")
    after = F.col(f"f.{month}") >= add_months(month_of(f"e.{start}"), 1)
    inside = F.col(f"e.{end}").isNull() | (F.col(f"f.{month}") < month_of(f"e.{end}"))
    return f.join(e, (F.col(f"f.{key}") == F.col(f"e.{key}")) & after & inside).drop(F.col(f"e.{key}"))


def lookback_join(facts: DataFrame, events: DataFrame, key: str, months: int = 12, month: str = "month_start", start: str = "event_dt") -> DataFrame:
    """Facts of the `months` months before the event's month."""
    f, e = facts.alias("f"), events.alias("e")
    first = add_months(month_of(f"e.{start}"), -months)
    return f.join(e, (F.col(f"f.{key}") == F.col(f"e.{key}")) & (F.col(f"f.{month}") >= first) & (F.col(f"f.{month}") < month_of(f"e.{start}"))).drop(F.col(f"e.{key}"))


def overlap_join(segments: DataFrame, events: DataFrame, key: str, days: int = 90, seg_start: str = "start_dt", seg_end: str = "end_dt", start: str = "event_dt", end: str = "window_end") -> DataFrame:
    """Segments that go on more than `days` days after the event and begin before the window ends; open ends are null."""
    s, e = segments.alias("s"), events.alias("e")
    late = F.col(f"s.{seg_end}").isNull() | (F.col(f"s.{seg_end}") > F.date_add(F.col(f"e.{start}"), days))
    early = F.col(f"e.{end}").isNull() | (F.col(f"s.{seg_start}") < F.col(f"e.{end}"))
    return s.join(e, (F.col(f"s.{key}") == F.col(f"e.{key}")) & late & early).drop(F.col(f"e.{key}"))


def day_window_join(claims: DataFrame, events: DataFrame, key: str, day: str = "service_dt", start: str = "event_dt", end: str = "window_end") -> DataFrame:
    """Claims with a service day after the event and up to the end of its window, that day included."""
    c, e = claims.alias("c"), events.alias("e")
    inside = (F.col(f"c.{day}") > F.col(f"e.{start}")) & (F.col(f"e.{end}").isNull() | (F.col(f"c.{day}") <= F.col(f"e.{end}")))
    return c.join(e, (F.col(f"c.{key}") == F.col(f"e.{key}")) & inside).drop(F.col(f"e.{key}"))


def workdays(start, end) -> Column:
    """Days from Monday to Friday from start to end, both included."""
    return F.size(F.filter(F.sequence(F.to_date(start), F.to_date(end)), lambda d: F.dayofweek(d).between(2, 6)))
