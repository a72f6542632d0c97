"""Procedure norms by code, and the signal of a provider whose dominant codes stand out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimlens.operators.ranking import percent_rank, top_per_group
from claimlens.operators.robust import quantile


def code_table(lines: DataFrame) -> DataFrame:
    """lines: npi, hcpcs, month_start, paid_c, patients, lines, charge_c, allowed_c, high_vector. Per npi and code: paid,
    patient months, months, dollars a patient month (dpm) with its percentile among the code's providers, the share of the
    provider's dollars, charges over allowed amounts, services."""
    c = lines.groupBy("npi", "hcpcs").agg(
        F.sum("paid_c").alias("paid_c"), F.sum("patients").alias("patient_months"), F.countDistinct("month_start").alias("months"), F.bool_or("high_vector").alias("high_vector"),
        F.sum("charge_c").alias("charge_c"), F.sum("allowed_c").alias("allowed_c"), F.sum("lines").alias("services"),
    )
    c = c.withColumn("dpm", F.try_divide(F.col("paid_c").cast("double"), F.col("patient_months"))).withColumn("charge_ratio", F.try_divide(F.col("charge_c").cast("double"), F.col("allowed_c")))
    c = c.withColumn("pct", percent_rank("dpm", ["hcpcs"]))
    total = c.groupBy("npi").agg(F.sum("paid_c").alias("total_c"))
    return c.join(total, "npi").withColumn("share", F.try_divide(F.col("paid_c").cast("double"), F.col("total_c"))).drop("total_c")


def code_norms(codes: DataFrame, least: int = 20) -> DataFrame:
    """Per code with at least `least` providers: quantiles of dollars a patient month and the median charge ratio."""
    g = codes.groupBy("hcpcs").agg(F.count("*").alias("n"), *(quantile("dpm", p).alias(f"p{int(p * 100)}") for p in (0.5, 0.9, 0.95)), F.median("charge_ratio").alias("peer_ratio"))
    return g.where(F.col("n") >= least)


def signal(codes: DataFrame, norms: DataFrame, top: int = 5, pct: float = 0.95, months: int = 12, patients: int = 50, share: float = 0.6, ratio: float = 3.0, services: int = 50) -> DataFrame:
    """0 to 8 points for an npi's `top` codes by dollars: 4 for a code in the top of its providers with enough months and
    patients, 2 for most dollars on codes of high vector, 2 for charges far above the code's usual ratio. Only those with
    points, with the code that stands out most (the larger code among equals) and a text."""
    c = top_per_group(codes, ["npi"], [F.col("paid_c").desc(), F.col("hcpcs")], top).join(norms.select("hcpcs", "peer_ratio"), "hcpcs", "left")
    hot = F.coalesce((F.col("pct") >= pct) & (F.col("months") >= months) & (F.col("patient_months") >= patients), F.lit(False))
    over = F.coalesce((F.col("charge_ratio") >= ratio * F.col("peer_ratio")) & (F.col("services") >= services), F.lit(False))
    per = c.groupBy("npi").agg(
        F.max(hot.cast("int")).alias("intense"), F.sum(F.when(F.col("high_vector"), F.col("share")).otherwise(0.0)).alias("high_share"), F.max(over.cast("int")).alias("over"),
        F.max(F.when(hot, F.struct("pct", "hcpcs"))).alias("hottest"), F.max(F.when(over, F.struct("charge_ratio", "hcpcs"))).alias("dearest"),
    )
    heavy = F.col("high_share") >= share
    points = 4 * F.col("intense") + F.when(heavy, 2).otherwise(0) + 2 * F.col("over")
    text = F.concat_ws("; ", F.when(F.col("intense") == 1, F.concat(F.lit("dollars per patient on code "), F.col("hottest.hcpcs"), F.lit(" among the highest"))), F.when(heavy, "most dollars on codes open to abuse"), F.when(F.col("over") == 1, F.concat(F.lit("charges on code "), F.col("dearest.hcpcs"), F.lit(" far above the usual"))))
    return per.select("npi", points.cast("int").alias("points"), F.col("hottest.hcpcs").alias("intense_code"), "high_share", text.alias("reason")).where("points > 0")


def lift(codes: DataFrame, flagged: DataFrame) -> DataFrame:
    """Per code: providers, flagged ones (flagged has npi), and how much likelier the flagged bill it than all do."""
    f = flagged.select("npi").distinct().withColumn("__f", F.lit(True))
    x = codes.select("npi", "hcpcs").distinct().join(f, "npi", "left").withColumn("__f", F.coalesce("__f", F.lit(False)))
    all_ = x.groupBy("hcpcs").agg(F.count("*").alias("n_all"), F.count_if("__f").alias("n_flagged"))
    total = F.broadcast(x.groupBy("npi").agg(F.max("__f").alias("f")).agg(F.count("*").alias("__n"), F.count_if("f").alias("__nf")))  # one row
    return all_.crossJoin(total).withColumn("lift", F.try_divide(F.try_divide(F.col("n_flagged").cast("double"), F.col("__nf")), F.col("n_all") / F.col("__n"))).drop("__n", "__nf")
