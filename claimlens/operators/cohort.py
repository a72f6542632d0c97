"""The out-of-time cohort: behaviour of each provider up to a month, engineered features, and whether a list names it later."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from claimlens.operators.ranking import framed_median, top_per_group

# Grounds of an exclusion for fraud.
FRAUD_GROUNDS = ("1128a1", "1128a2", "1128a3", "1128b7")
MIN_PAID = 1000


def behaviour(months: DataFrame, until: str, least_c: int = MIN_PAID * 100) -> DataFrame:
    """Per npi paid at least least_c cents up to the month `until` (its first day, included): months has npi, month_start,
    paid_c, lines, patients, counterparties, one row a month. Totals, the last and the previous year, the last twelve months,
    the share of the three largest months, and ramp: the largest month over the median of the up to six before it (of at
    least three), 1 where there is none."""
    end = F.lit(until).cast("date")
    s = months.where(F.col("month_start") <= end)
    w = Window.partitionBy("npi").orderBy("month_start").rowsBetween(-6, -1)
    x = s.withColumn("__med", framed_median("paid_c", ["npi"], ["month_start"], 6)).withColumn("__n", F.count("*").over(w))
    year = F.year("month_start")
    of = lambda c: F.sum(F.when(c, F.col("paid_c")).otherwise(0))
    agg = x.groupBy("npi").agg(
        F.sum("paid_c").alias("paid_c"), F.count("*").alias("n_months"), F.max("paid_c").alias("max_month_c"), of(year == F.year(end)).alias("last_year_c"), of(year == F.year(end) - 1).alias("prev_year_c"),
        of(F.col("month_start") >= F.add_months(end, -11)).alias("last_12m_c"), F.max(F.when((F.col("__n") >= 3) & (F.col("__med") > 0), F.col("paid_c") / F.col("__med"))).alias("ramp"),
        F.max("counterparties").alias("max_counterparties"), F.max("patients").alias("max_patients"), F.sum("lines").alias("lines"), F.min("month_start").alias("first_month"), F.max("month_start").alias("last_month"),
    )
    top = top_per_group(s, ["npi"], [F.col("paid_c").desc(), F.col("month_start")], 3).groupBy("npi").agg(F.sum("paid_c").alias("__top"))
    out = agg.where(F.col("paid_c") >= least_c).join(top, "npi", "left")
    return out.withColumn("ramp", F.coalesce("ramp", F.lit(1.0))).withColumn("top3_share", F.try_divide(F.col("__top").cast("double"), F.col("paid_c"))).drop("__top")


def volume_history(months: DataFrame, until: str) -> DataFrame:
    """Per npi, of months (npi, month_start, hours_day, personal_hours_day, n_billing) up to `until`: months over 24 and over
    16 hours a day, the peak, and how many of the first had several billing organisations."""
    x = months.where(F.col("month_start") <= F.lit(until).cast("date"))
    over = F.col("hours_day") > 24
    return x.groupBy("npi").agg(F.count_if(over).alias("m_over24"), F.count_if(F.col("hours_day") > 16).alias("m_over16"), F.max("personal_hours_day").alias("peak_hours"), F.max("n_billing").alias("max_billing"), F.count_if(over & (F.col("n_billing") >= 3)).alias("m_over24_concurrent"))


def later(lists: list[DataFrame], after: str) -> DataFrame:
    """npi of those that any of the lists (npi, event_dt) names on or after a day: the label 1."""
    rows = reduce(DataFrame.union, [x.where(F.col("event_dt") >= F.lit(after).cast("date")).select("npi") for x in lists])
    return rows.where("npi is not null").distinct().withColumn("y", F.lit(1))


def before(lists: list[DataFrame], until: str) -> DataFrame:
    """npi of those that any of the lists names up to a day: prior_admin 1."""
    rows = reduce(DataFrame.union, [x.where(F.col("event_dt") <= F.lit(until).cast("date")).select("npi") for x in lists])
    return rows.where("npi is not null").distinct().withColumn("prior_admin", F.lit(1))


def cohort(base: DataFrame, volume: DataFrame, prior: DataFrame, registry: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """behaviour() with what volume_history(), before(), the registry (npi, entity_type) and later() know; 0 where nothing is."""
    x = base.join(volume, "npi", "left").join(prior, "npi", "left").join(registry.select("npi", "entity_type"), "npi", "left")
    if labels is not None:
        x = x.join(labels, "npi", "left")
    zero = [c for c in (*volume.columns, "prior_admin", "y") if c != "npi" and c in x.columns]
    return x.na.fill(0, zero)


def _clip(c: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), c.cast("double")))


def engineered(x: DataFrame) -> dict[str, Column]:
    """The features of a cohort's row: logarithms of sizes, bounded ratios and counts. Amounts count in dollars."""
    usd = lambda c: F.col(c) / 100
    per_patient = F.coalesce(F.try_divide(usd("max_month_c"), F.nullif("max_patients", F.lit(0))), F.lit(0.0))
    return {
        "log_paid": F.log10(F.greatest(usd("paid_c"), F.lit(1.0))), "log_paid_ly": F.log10(F.greatest(usd("last_year_c"), F.lit(1.0))), "growth": _clip(F.log((usd("last_year_c") + 1) / (usd("prev_year_c") + 1)), -6, 6),
        "log_ramp": _clip(F.log(F.greatest("ramp", F.lit(1.0))), 0, 6), "top3_share": _clip(F.coalesce("top3_share", F.lit(1.0)), 0, 1), "n_months": F.col("n_months").cast("double"),
        "log_counterparties": F.log1p(F.coalesce("max_counterparties", F.lit(0))), "log_patients": F.log1p(F.coalesce("max_patients", F.lit(0))), "paid_per_patient": F.log10(F.greatest(per_patient, F.lit(0.0)) + 1),
        "m_over24": _clip(F.col("m_over24"), 0, 24), "m_over16": _clip(F.col("m_over16"), 0, 36), "peak_hours": _clip(F.coalesce("peak_hours", F.lit(0.0)), 0, 200), "m_over24_concurrent": _clip(F.col("m_over24_concurrent"), 0, 24),
        "max_billing": _clip(F.col("max_billing"), 0, 50), "prior_admin": F.col("prior_admin").cast("double"), "individual": F.coalesce(F.col("entity_type") == "1", F.lit(False)).cast("double"),
    }
