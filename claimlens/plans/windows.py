"""Window operators: top rows, lags, ranks, framed medians, bursts, deciles."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from claimlens.operators.ranking import average_rank, best_row, burst, framed_median, global_rank, percent_rank, top_per_group
from claimlens.plans.data import BILL_MONTH, bill_month, cents, r4, table


def top1(spark, sf_dir):
    """The latest order of each customer, by an aggregate that combines before the shuffle."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.to_date("o_orderdate").alias("day"), cents("o_totalprice").alias("total_c"))
    return best_row(o, ["o_custkey"], F.struct("day", "o_orderkey"), largest=True)


TOP1 = """SELECT o_custkey, o_orderkey, CAST(o_orderdate AS DATE) AS day, CAST(round(o_totalprice * 100) AS BIGINT) AS total_c FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE) DESC, o_orderkey DESC) = 1"""


def topk(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", cents("l_extendedprice").alias("paid_c"))
    return top_per_group(li, ["l_suppkey"], [F.col("paid_c").desc(), F.col("l_orderkey"), F.col("l_linenumber")], 5, "rank").withColumn("rank", F.col("rank").cast("long"))


TOPK = """SELECT l_suppkey, l_orderkey, CAST(l_linenumber AS INTEGER) AS l_linenumber, CAST(round(l_extendedprice * 100) AS BIGINT) AS paid_c,
  row_number() OVER (PARTITION BY l_suppkey ORDER BY CAST(round(l_extendedprice * 100) AS BIGINT) DESC, l_orderkey, l_linenumber) AS rank FROM lineitem QUALIFY rank <= 5"""


def lag_growth(spark, sf_dir):
    y = bill_month(spark, sf_dir).groupBy("npi", F.year("month_start").alias("year")).agg(F.sum("paid_c").alias("paid_c"))
    w = Window.partitionBy("npi").orderBy("year")
    return y.withColumn("prev_c", F.lag("paid_c").over(w)).withColumn("growth", F.when(F.col("prev_c") > 0, F.col("paid_c").cast("double") / F.col("prev_c")))


LAG = f"""WITH {BILL_MONTH}, y AS (SELECT npi, CAST(year(month_start) AS INTEGER) AS year, CAST(sum(paid_c) AS BIGINT) AS paid_c FROM bill_month GROUP BY 1, 2), l AS (SELECT *, lag(paid_c) OVER (PARTITION BY npi ORDER BY year) AS prev_c FROM y)
SELECT *, CASE WHEN prev_c > 0 THEN CAST(paid_c AS DOUBLE) / prev_c END AS growth FROM l"""


def ranks(spark, sf_dir):
    """percent_rank with nulls last, mean rank of ties as a share, count per group."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", F.when(F.col("o_orderkey") % 7 != 0, F.floor(F.col("o_totalprice") / 1000).cast("long")).alias("v"))
    return o.select("o_orderkey", percent_rank("v", ["o_orderpriority"]).alias("pct"), average_rank("v", ["o_orderpriority"]).alias("avg_rank"), F.count("*").over(Window.partitionBy("o_orderpriority")).alias("n"))


RANKS = """WITH o AS (SELECT o_orderkey, o_orderpriority, CASE WHEN o_orderkey % 7 <> 0 THEN CAST(floor(o_totalprice / 1000) AS BIGINT) END AS v FROM orders)
SELECT o_orderkey, percent_rank() OVER (PARTITION BY o_orderpriority ORDER BY v ASC NULLS LAST) AS pct,
  CASE WHEN v IS NOT NULL THEN (rank() OVER (PARTITION BY o_orderpriority, v IS NULL ORDER BY v) + (count(*) OVER (PARTITION BY o_orderpriority, v) - 1) / 2) / count(*) OVER (PARTITION BY o_orderpriority, v IS NULL) END AS avg_rank,
  count(*) OVER (PARTITION BY o_orderpriority) AS n FROM o"""


def framed(spark, sf_dir):
    """Median and number of the six months before, for surge detection."""
    m = bill_month(spark, sf_dir)
    w = Window.partitionBy("npi").orderBy("month_start").rowsBetween(-6, -1)
    x = m.withColumn("med6", framed_median("paid_c", ["npi"], ["month_start"], 6)).withColumn("n6", F.count("*").over(w))
    return x.select("npi", "month_start", "paid_c", "med6", "n6", F.when((F.col("n6") >= 3) & (F.col("paid_c") >= 3 * F.col("med6")), True).otherwise(False).alias("surge"))


FRAMED = f"""WITH {BILL_MONTH}, x AS (SELECT npi, month_start, paid_c, median(paid_c) OVER w AS med6, count(*) OVER w AS n6 FROM bill_month WINDOW w AS (PARTITION BY npi ORDER BY month_start ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING))
SELECT *, CASE WHEN n6 >= 3 AND paid_c >= 3 * med6 THEN TRUE ELSE FALSE END AS surge FROM x"""


def ranked(spark, sf_dir):
    """A rank over all rows, without gathering them in one task."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", cents("o_totalprice").alias("total_c"))
    return global_rank(o, [F.col("total_c").desc(), F.col("o_orderkey")])


RANKED = "SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS total_c, row_number() OVER (ORDER BY CAST(round(o_totalprice * 100) AS BIGINT) DESC, o_orderkey) AS rank FROM orders"


def bursts(spark, sf_dir):
    """The most orders of a customer within 90 days."""
    o = table(spark, sf_dir, "orders").select("o_custkey", F.to_date("o_orderdate").alias("day"))
    return burst(o, ["o_custkey"], "day", 90).select("o_custkey", "most", F.date_add(F.lit("1970-01-01").cast("date"), F.col("first_day")).alias("first_day"))


BURSTS = """WITH o AS (SELECT o_custkey, CAST(o_orderdate AS DATE) AS day FROM orders), w AS (SELECT o_custkey, day, count(*) OVER (PARTITION BY o_custkey ORDER BY day RANGE BETWEEN CURRENT ROW AND INTERVAL 90 DAY FOLLOWING) AS n FROM o)
SELECT o_custkey, max(n) AS most, min(day) FILTER (WHERE n = m) AS first_day FROM (SELECT *, max(n) OVER (PARTITION BY o_custkey) AS m FROM w) GROUP BY 1"""


def deciles(spark, sf_dir):
    """Ten classes of equal size by rank, with the share of positives in each. Class of rank r of n is ceil(10 r / n)."""
    c = table(spark, sf_dir, "customer").select("c_custkey", cents("c_acctbal").alias("bal_c"))
    x = global_rank(c, [F.col("bal_c"), F.col("c_custkey")])
    total = c.agg(F.count("*").alias("total"))
    x = x.crossJoin(F.broadcast(total)).withColumn("decile", F.ceil(10 * F.col("rank") / F.col("total")).cast("int"))
    return x.groupBy("decile").agg(F.count("*").alias("n"), F.min("bal_c").alias("lo_c"), F.max("bal_c").alias("hi_c"), r4(F.avg((F.col("c_custkey") % 3 == 0).cast("int"))).alias("rate"))


DECILES = """WITH r AS (SELECT c_custkey, CAST(round(c_acctbal * 100) AS BIGINT) AS bal_c, row_number() OVER (ORDER BY CAST(round(c_acctbal * 100) AS BIGINT), c_custkey) AS rank, count(*) OVER () AS total FROM customer)
SELECT CAST(ceil(10 * rank / total) AS INTEGER) AS decile, count(*) AS n, min(bal_c) AS lo_c, max(bal_c) AS hi_c, round(avg(CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END), 4) AS rate FROM r GROUP BY 1"""

QUERIES = {
    "win_top1": (top1, TOP1),
    "win_topk": (topk, TOPK),
    "win_lag_growth": (lag_growth, LAG),
    "win_ranks": (ranks, RANKS),
    "win_framed_median": (framed, FRAMED),
    "win_global_rank": (ranked, RANKED),
    "win_burst": (bursts, BURSTS),
    "win_deciles": (deciles, DECILES),
}
