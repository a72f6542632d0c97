"""Paid after a list action: the flagship query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimlens.operators.temporal import lookback_join, month_window_join
from claimlens.plans.data import BILL_MONTH, EVENTS, bill_month, events


def paid_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per event: months paid and dollars inside its window, the year before it, and the score."""
    months, listed = bill_month(spark, sf_dir), events(spark, sf_dir)
    after = month_window_join(months, listed, "npi").groupBy("npi").agg(
        F.count("*").alias("months_paid"), (F.sum("paid_c") / 100).alias("paid_after"), F.min("month_start").alias("first_month"), F.max("month_start").alias("last_month"))
    before = lookback_join(months, listed, "npi").groupBy("npi").agg((F.sum("paid_c") / 100).alias("paid_before"))
    df = listed.join(after, "npi").join(before, "npi", "left")
    score = 2 * (F.col("tier") == "A").cast("int") + (F.col("months_paid") >= 12).cast("int") + F.coalesce(F.col("paid_before") > 0, F.lit(False)).cast("int")
    return df.select("npi", "tier", "event_dt", "window_end", "months_paid", "paid_after", "paid_before", "first_month", "last_month", score.alias("score"))


PAID_AFTER = f"""WITH {BILL_MONTH}, {EVENTS}, a AS (
  SELECT e.npi, count(*) AS months_paid, CAST(sum(paid_c) AS BIGINT) / 100 AS paid_after, min(month_start) AS first_month, max(month_start) AS last_month
  FROM bill_month m JOIN events_list e ON m.npi = e.npi AND month_start >= date_trunc('month', event_dt) + INTERVAL 1 MONTH
    AND (window_end IS NULL OR month_start < date_trunc('month', window_end)) GROUP BY 1
), b AS (
  SELECT e.npi, CAST(sum(paid_c) AS BIGINT) / 100 AS paid_before
  FROM bill_month m JOIN events_list e ON m.npi = e.npi AND month_start >= date_trunc('month', event_dt) - INTERVAL 12 MONTH AND month_start < date_trunc('month', event_dt) GROUP BY 1
)
SELECT npi, tier, event_dt, window_end, CAST(months_paid AS BIGINT) AS months_paid, paid_after, paid_before, first_month, last_month,
  CAST(2 * CAST(tier = 'A' AS INTEGER) + CAST(months_paid >= 12 AS INTEGER) + CAST(coalesce(paid_before > 0, FALSE) AS INTEGER) AS INTEGER) AS score
FROM events_list JOIN a USING (npi) LEFT JOIN b USING (npi)"""

QUERIES = {"paid_after": (paid_after, PAID_AFTER)}
