"""Aggregations: conditional, quantile, robust, pivot, share, lift, mode."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from claimlens.operators.ranking import top_per_group
from claimlens.operators.robust import median_mad, quantile, robust_z
from claimlens.plans.data import SPEND, STATES, cents, lines, r4, spend, states, table


def conditional(spark, sf_dir):
    """Several distinct counts and conditional sums in one pass."""
    li = table(spark, sf_dir, "lineitem")
    paid = cents("l_extendedprice")
    return li.groupBy("l_returnflag", "l_linestatus").agg(
        F.count("*").alias("n"), F.countDistinct("l_suppkey").alias("n_supp"), F.countDistinct("l_partkey").alias("n_part"), F.count_if(F.col("l_discount") > 0.05).alias("n_discounted"),
        F.sum(F.when(F.col("l_quantity") >= 25, paid).otherwise(0)).alias("large_c"), F.bool_or(F.col("l_tax") == 0).alias("any_untaxed"), F.bool_and(F.col("l_quantity") > 0).alias("all_positive"), F.avg(F.col("l_quantity").cast("long")).alias("avg_qty"),
    )


CONDITIONAL = """SELECT l_returnflag, l_linestatus, count(*) AS n, count(DISTINCT l_suppkey) AS n_supp, count(DISTINCT l_partkey) AS n_part, count(*) FILTER (WHERE l_discount > 0.05) AS n_discounted,
  CAST(sum(CASE WHEN l_quantity >= 25 THEN CAST(round(l_extendedprice * 100) AS BIGINT) ELSE 0 END) AS BIGINT) AS large_c, bool_or(l_tax = 0) AS any_untaxed, bool_and(l_quantity > 0) AS all_positive, avg(CAST(l_quantity AS BIGINT)) AS avg_qty
FROM lineitem GROUP BY 1, 2"""


def quantiles(spark, sf_dir):
    """Exact quantiles, some over a filtered part, with minimum support."""
    li = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    x = F.col("l_extendedprice")
    trimmed = F.expr("percentile(l_extendedprice, 0.05) FILTER (WHERE l_quantity >= 10)")
    g = li.groupBy("p_brand", "p_type").agg(F.count("*").alias("n"), *(r4(quantile(x, p)).alias(f"p{int(p * 100):02d}") for p in (0.05, 0.25, 0.5, 0.75, 0.9, 0.95)), r4(trimmed).alias("p05_trim"))
    return g.where("n >= 30")


QUANTILES = f"""SELECT p_brand, p_type, count(*) AS n, {', '.join(f'round(quantile_cont(l_extendedprice, {p}), 4) AS p{int(p * 100):02d}' for p in (0.05, 0.25, 0.5, 0.75, 0.9, 0.95))},
  round(quantile_cont(l_extendedprice, 0.05) FILTER (WHERE l_quantity >= 10), 4) AS p05_trim
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2 HAVING count(*) >= 30"""


def mad(spark, sf_dir):
    """Median, MAD and robust z within a group, in two passes."""
    o = table(spark, sf_dir, "orders")
    base = median_mad(o, ["o_orderpriority"], "o_totalprice", 20)
    return o.join(base, "o_orderpriority").select("o_orderkey", "o_orderpriority", r4(F.col("med")).alias("med"), r4(F.col("mad")).alias("mad"), r4(robust_z("o_totalprice", "med", "mad")).alias("z"))


MAD = """WITH m AS (SELECT o_orderpriority, median(o_totalprice) AS med FROM orders GROUP BY 1 HAVING count(*) >= 20),
d AS (SELECT o_orderpriority, max(med) AS med, median(abs(o_totalprice - med)) AS mad FROM orders JOIN m USING (o_orderpriority) GROUP BY 1)
SELECT o_orderkey, o_orderpriority, round(med, 4) AS med, round(mad, 4) AS mad, round(0.6745::DOUBLE * (o_totalprice - med) / nullif(mad, 0), 4) + 0.0::DOUBLE AS z FROM orders JOIN d USING (o_orderpriority)"""


def lists(spark, sf_dir):
    """Distinct values as sorted text and as a list; the value at the largest key, null values skipped; any value; first filled value."""
    s = spend(spark, sf_dir)
    return s.groupBy("npi").agg(
        F.array_join(F.array_sort(F.collect_set("family")), ",").alias("families"), F.array_sort(F.collect_set("year")).alias("years"),
        F.expr("max_by(case when minutes > 25 then hcpcs end, struct(paid_c, servicing, hcpcs)) FILTER (WHERE minutes > 25)").alias("top_code"),
        F.expr("min_by(hcpcs, struct(month_start, paid_c, servicing, hcpcs)) FILTER (WHERE minutes > 25)").alias("first_filled"), F.any_value(F.col("npi") % 100).alias("any_mod"),
    )


LISTS = f"""WITH {SPEND} SELECT npi, string_agg(DISTINCT family, ',' ORDER BY family) AS families, list(DISTINCT year ORDER BY year) AS years,
  arg_max(CASE WHEN minutes > 25 THEN hcpcs END, (paid_c, servicing, hcpcs)) FILTER (WHERE minutes > 25) AS top_code, arg_min(hcpcs, (month_start, paid_c, servicing, hcpcs)) FILTER (WHERE minutes > 25) AS first_filled, any_value(npi % 100) AS any_mod FROM spend GROUP BY 1"""


def weighted_mean(spark, sf_dir):
    s = lines(spark, sf_dir)
    return s.groupBy("hcpcs").agg(F.try_divide(F.sum(F.col("minutes").cast("long") * F.col("lines")).cast("double"), F.nullif(F.sum("lines"), F.lit(0)).cast("double")).alias("mean_minutes"))


WEIGHTED_MEAN = f"WITH {SPEND} SELECT hcpcs, CAST(sum(CAST(minutes AS BIGINT) * lines) AS DOUBLE) / CAST(nullif(sum(lines), 0) AS DOUBLE) AS mean_minutes FROM spend GROUP BY 1"


def pivot_years(spark, sf_dir):
    """npi by year, missing years as zero, and the growth between two of them."""
    s = lines(spark, sf_dir)
    wide = s.groupBy("npi").pivot("year", [1996, 1997, 1998, 1999, 2000]).agg(F.sum("paid_c")).na.fill(0)
    wide = wide.select("npi", *(F.col(str(y)).alias(f"y{y}") for y in range(1996, 2001)))
    return wide.withColumn("growth", F.try_divide(F.col("y2000").cast("double"), F.nullif("y1996", F.lit(0)).cast("double")))


PIVOT_YEARS = f"""WITH {SPEND}, w AS (SELECT npi, {', '.join(f'CAST(coalesce(sum(paid_c) FILTER (WHERE year = {y}), 0) AS BIGINT) AS y{y}' for y in range(1996, 2001))} FROM spend GROUP BY 1)
SELECT *, CAST(y2000 AS DOUBLE) / CAST(nullif(y1996, 0) AS DOUBLE) AS growth FROM w"""


def share_of_group(spark, sf_dir):
    """Each status's share of its state: an aggregate and a window over the groups."""
    o = table(spark, sf_dir, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"))
    return o.withColumn("share", F.col("n").cast("double") / F.sum("n").over(Window.partitionBy("o_orderpriority")))


SHARE = """SELECT o_orderpriority, o_orderstatus, count(*) AS n, CAST(count(*) AS DOUBLE) / CAST(sum(count(*)) OVER (PARTITION BY o_orderpriority) AS DOUBLE) AS share FROM orders GROUP BY 1, 2"""


def lift(spark, sf_dir):
    """How much more often a code is billed by flagged providers: a ratio of ratios against the totals."""
    s = lines(spark, sf_dir).withColumn("flagged", F.col("npi") % 5 == 0)
    by = s.groupBy("hcpcs").agg(F.count("*").alias("n"), F.count_if("flagged").alias("n_flagged"))
    total = s.agg(F.count("*").alias("t"), F.count_if("flagged").alias("tf"))
    x = by.crossJoin(F.broadcast(total))  # one row
    return x.select("hcpcs", "n", "n_flagged", r4(F.try_divide(F.col("n_flagged") / F.col("tf"), F.col("n") / F.col("t"))).alias("lift"))


LIFT = f"""WITH {SPEND}, t AS (SELECT count(*) AS t, count(*) FILTER (WHERE npi % 5 = 0) AS tf FROM spend), b AS (SELECT hcpcs, count(*) AS n, count(*) FILTER (WHERE npi % 5 = 0) AS n_flagged FROM spend GROUP BY 1)
SELECT hcpcs, n, n_flagged, round((CAST(n_flagged AS DOUBLE) / tf) / (CAST(n AS DOUBLE) / t), 4) AS lift FROM b, t"""


def most_frequent(spark, sf_dir):
    """The most frequent value per group; ties go to the smaller value."""
    n = lines(spark, sf_dir).groupBy("npi", "family").agg(F.count("*").alias("n"))
    return top_per_group(n, ["npi"], [F.col("n").desc(), F.col("family")])


MODE = f"WITH {SPEND}, c AS (SELECT npi, family, count(*) AS n FROM spend GROUP BY 1, 2) SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY npi ORDER BY n DESC, family) = 1"


def tier_rollup(spark, sf_dir):
    """Conditional sums by tier, rolled up to an area with its point on the map."""
    s = lines(spark, sf_dir).join(states(spark, sf_dir).select("npi", "state", "nation"), "npi")
    tier = F.col("npi") % 3
    return s.groupBy("state", "nation").agg(*(F.sum(F.when(tier == i, F.col("paid_c")).otherwise(0)).alias(f"tier{i}_c") for i in range(3)), F.countDistinct("npi").alias("n_npi"), F.max_by("npi", F.struct("paid_c", "npi")).alias("top_npi")).join(F.broadcast(table(spark, sf_dir, "nation").select(F.col("n_name").alias("nation"), (F.col("n_nationkey") * 3 - 30).cast("double").alias("lat"), (F.col("n_nationkey") * 7 - 90).cast("double").alias("lon"))), "nation", "left")


TIER_ROLLUP = f"""WITH {SPEND}, {STATES} SELECT state, nation, {', '.join(f'CAST(sum(CASE WHEN npi % 3 = {i} THEN paid_c ELSE 0 END) AS BIGINT) AS tier{i}_c' for i in range(3))}, count(DISTINCT npi) AS n_npi, arg_max(npi, (paid_c, npi)) AS top_npi,
  CAST(any_value(n_nationkey) * 3 - 30 AS DOUBLE) AS lat, CAST(any_value(n_nationkey) * 7 - 90 AS DOUBLE) AS lon FROM spend JOIN states USING (npi) JOIN nation ON n_name = nation GROUP BY 1, 2"""

QUERIES = {
    "agg_conditional": (conditional, CONDITIONAL),
    "agg_quantiles": (quantiles, QUANTILES),
    "agg_mad_robust_z": (mad, MAD),
    "agg_lists_arg_max": (lists, LISTS),
    "agg_weighted_mean": (weighted_mean, WEIGHTED_MEAN),
    "agg_pivot_growth": (pivot_years, PIVOT_YEARS),
    "agg_share_of_group": (share_of_group, SHARE),
    "agg_lift": (lift, LIFT),
    "agg_mode": (most_frequent, MODE),
    "agg_tier_rollup": (tier_rollup, TIER_ROLLUP),
}
