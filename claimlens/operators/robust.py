"""Robust statistics: medians, median absolute deviations and the z-scores built on them, with exact quantiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def quantile(value, p: float) -> Column:
    """Exact, interpolated between neighbours."""
    return F.percentile(value, F.lit(p))


def median_mad(df: DataFrame, keys: list[str], value: str, min_rows: int = 1, count: Column | None = None) -> DataFrame:
    """keys, n, med, mad: two passes, the group's median joined back before the deviations are taken."""
    med = df.groupBy(*keys).agg((count if count is not None else F.count(value)).alias("n"), F.median(value).alias("med")).where(F.col("n") >= min_rows)
    dev = df.join(med, keys).groupBy(*keys).agg(F.max("n").alias("n"), F.max("med").alias("med"), F.median(F.abs(F.col(value) - F.col("med"))).alias("mad"))
    return dev


def robust_z(value, med, mad) -> Column:
    """0.6745 (x - median) / MAD; null where the MAD is zero."""
    v, m, d = (F.col(x) if isinstance(x, str) else x for x in (value, med, mad))
    return F.try_divide(0.6745 * (v - m), d)


def robust_z_filled(df: DataFrame, value: str, name: str, clip: float = 5.0) -> DataFrame:
    """Over all rows: MAD, or the standard deviation where it is zero, or 1; clipped; null becomes 0."""
    med = df.agg(F.median(value).alias("__med"), F.stddev_samp(value).alias("__sd"))
    x = df.crossJoin(F.broadcast(med))  # one row
    mad = x.agg(F.median(F.abs(F.col(value) - F.col("__med"))).alias("__mad"))
    x = x.crossJoin(F.broadcast(mad))
    scale = F.when(F.col("__mad") > 0, F.col("__mad") / 0.6745).when(F.col("__sd") > 0, F.col("__sd")).otherwise(1.0)
    z = F.coalesce(F.greatest(F.lit(-clip), F.least(F.lit(clip), (F.col(value) - F.col("__med")) / scale)), F.lit(0.0))
    return x.withColumn(name, z).drop("__med", "__sd", "__mad")


def robust_z_directed(value, med, mad, n, higher_is_worse: bool = True, least: int = 5) -> Column:
    """(x - median) / (1.4826 MAD), signed so that higher is worse; 0 where the MAD is zero; null for fewer than
    `least` values."""
    v, m, d, k = (F.col(x) if isinstance(x, str) else x for x in (value, med, mad, n))
    z = F.coalesce(F.try_divide(v - m, 1.4826 * d), F.lit(0.0)) * (1.0 if higher_is_worse else -1.0)
    return F.when(k >= least, F.when(v.isNotNull(), z))


def with_fallback(df: DataFrame, fine: DataFrame, fine_keys: list[str], coarse: DataFrame, coarse_keys: list[str]) -> DataFrame:
    """Baselines by the fine keys where there is one, else by the coarse keys: baseline_level, baseline_median, baseline_mad."""
    f = fine.select(*fine_keys, F.col("med").alias("__fm"), F.col("mad").alias("__fd"))
    c = coarse.select(*coarse_keys, F.col("med").alias("__cm"), F.col("mad").alias("__cd"))
    x = df.join(f, fine_keys, "left").join(c, coarse_keys, "left")
    level = F.when(F.col("__fm").isNotNull(), "fine").when(F.col("__cm").isNotNull(), "coarse")
    return x.withColumn("baseline_level", level).withColumn("baseline_median", F.coalesce("__fm", "__cm")).withColumn("baseline_mad", F.when(F.col("__fm").isNotNull(), F.col("__fd")).otherwise(F.col("__cd"))).drop("__fm", "__fd", "__cm", "__cd")
