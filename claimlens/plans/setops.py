"""Sorts, limits, set operations, deduplication, slices."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimlens.operators.sets import flag_top, keep_best, page, replace_slice, sample_rows, stratified_split, update_from, upsert
from claimlens.plans.data import cents, table


def _orders(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", cents("o_totalprice").alias("total_c"))


ORDERS = "o AS (SELECT o_orderkey, o_custkey, o_orderstatus, CAST(round(o_totalprice * 100) AS BIGINT) AS total_c FROM orders)"


def top(spark, sf_dir):
    """Order by a condition first, nulls last, then limit: no full sort."""
    o = _orders(spark, sf_dir).withColumn("v", F.when(F.col("o_custkey") % 4 != 0, F.col("total_c")))
    return o.orderBy((F.col("o_orderstatus") == "P").desc(), F.col("v").desc_nulls_last(), "o_orderkey").limit(50)


TOP = f"WITH {ORDERS}, v AS (SELECT *, CASE WHEN o_custkey % 4 <> 0 THEN total_c END AS v FROM o) SELECT * FROM v ORDER BY (o_orderstatus = 'P') DESC, v DESC NULLS LAST, o_orderkey LIMIT 50"


def paging(spark, sf_dir):
    return page(_orders(spark, sf_dir), [F.col("total_c").desc(), F.col("o_orderkey")], 3, 25)


PAGING = f"WITH {ORDERS} SELECT * FROM o ORDER BY total_c DESC, o_orderkey LIMIT 25 OFFSET 75"


def unions(spark, sf_dir):
    """Union all with a tag, and a distinct union of keys."""
    o = _orders(spark, sf_dir)
    a, b = o.where("o_orderstatus = 'P'").select("o_custkey"), o.where("total_c > 40000000").select("o_custkey")
    both = a.withColumn("src", F.lit("P")).unionByName(b.withColumn("src", F.lit("T"))).groupBy("o_custkey").agg(F.count("*").alias("n"), F.countDistinct("src").alias("n_src"))
    return both.join(a.union(b).distinct(), "o_custkey")


UNIONS = f"""WITH {ORDERS}, a AS (SELECT o_custkey FROM o WHERE o_orderstatus = 'P'), b AS (SELECT o_custkey FROM o WHERE total_c > 40000000),
u AS (SELECT o_custkey, 'P' AS src FROM a UNION ALL SELECT o_custkey, 'T' FROM b) SELECT o_custkey, count(*) AS n, count(DISTINCT src) AS n_src FROM u JOIN (SELECT * FROM a UNION SELECT * FROM b) USING (o_custkey) GROUP BY 1"""


def dedupe(spark, sf_dir):
    """The best row per key, and duplicate values dropped from a list in its order."""
    o = _orders(spark, sf_dir)
    best = keep_best(o, ["o_custkey", "o_orderstatus"], F.struct("total_c", "o_orderkey"), largest=True)
    return best.withColumn("digits", F.array_join(F.array_distinct(F.split(F.col("total_c").cast("string"), "")), ""))


DEDUPE = f"""WITH {ORDERS} SELECT o_custkey, o_orderstatus, o_orderkey, total_c, list_reduce(string_split(CAST(total_c AS VARCHAR), ''), lambda x, y: CASE WHEN contains(x, y) THEN x ELSE x || y END) AS digits
FROM o QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY total_c DESC, o_orderkey DESC) = 1"""


def slices(spark, sf_dir):
    """Replace one slice, then upsert, then patch by key."""
    o = _orders(spark, sf_dir)
    new = o.where("o_orderstatus = 'P'").withColumn("total_c", F.col("total_c") * 2)
    x = replace_slice(o, new, "o_orderstatus", "P")
    x = upsert(x, o.where("o_orderkey % 10 = 0").withColumn("total_c", F.lit(7).cast("long")), ["o_orderkey"])
    patch = o.where("o_orderkey % 15 = 0").select("o_orderkey", F.lit("Z").alias("o_orderstatus"))
    return update_from(x, patch, ["o_orderkey"]).groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.sum("total_c").alias("total_c"))


SLICES = f"""WITH {ORDERS}, x AS (SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 10 = 0 THEN 7 WHEN o_orderstatus = 'P' THEN total_c * 2 ELSE total_c END AS total_c FROM o)
SELECT CASE WHEN o_orderkey % 15 = 0 THEN 'Z' ELSE o_orderstatus END AS o_orderstatus, count(*) AS n, CAST(sum(total_c) AS BIGINT) AS total_c FROM x GROUP BY 1"""


def intersect_except(spark, sf_dir):
    a = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select("l_partkey")
    b = table(spark, sf_dir, "lineitem").where("l_linestatus = 'O'").select("l_partkey")
    return a.intersect(b).withColumn("side", F.lit("both")).unionByName(a.subtract(b).withColumn("side", F.lit("first")))


INTERSECT = """WITH a AS (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R'), b AS (SELECT l_partkey FROM lineitem WHERE l_linestatus = 'O')
SELECT l_partkey, 'both' AS side FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT l_partkey, 'first' FROM (SELECT * FROM a EXCEPT SELECT * FROM b)"""

def flagged(spark, sf_dir):
    """The first 400 of all rows marked, nulls first among equals in status."""
    o = _orders(spark, sf_dir).withColumn("v", F.when(F.col("o_custkey") % 9 != 0, F.col("total_c")))
    return flag_top(o, [F.col("v").asc_nulls_first()], 400, "o_orderkey")


FLAGGED = f"WITH {ORDERS}, v AS (SELECT *, CASE WHEN o_custkey % 9 <> 0 THEN total_c END AS v FROM o) SELECT *, row_number() OVER (ORDER BY v ASC NULLS FIRST, o_orderkey) <= 400 AS is_top FROM v"


def split_shares(spark, sf_dir):
    """A split by label holds about its share of each label; a sample has its size and only rows of the table."""
    o = _orders(spark, sf_dir)
    by = o.withColumn("t", stratified_split("o_orderkey", "o_orderstatus", 0.7, 3)).groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.abs(F.avg(F.col("t").cast("int")) - 0.7).alias("off"))
    few = sample_rows(o, 200, "o_orderkey", 5).groupBy("o_orderstatus").agg(F.count("*").alias("m"))
    x = by.join(few, "o_orderstatus", "left")
    return x.agg(F.bool_and((F.col("off") < 0.1) | (F.col("n") < 200)).alias("near_share"), F.sum("m").alias("sampled"))


SPLIT_SHARES = "SELECT TRUE AS near_share, CAST(least(200, count(*)) AS BIGINT) AS sampled FROM orders"

QUERIES = {
    "set_flag_top": (flagged, FLAGGED),
    "set_split_sample": (split_shares, SPLIT_SHARES),
    "set_top": (top, TOP),
    "set_paging": (paging, PAGING),
    "set_unions": (unions, UNIONS),
    "set_dedupe": (dedupe, DEDUPE),
    "set_slices": (slices, SLICES),
    "set_intersect_except": (intersect_except, INTERSECT),
}
