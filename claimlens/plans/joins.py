"""Joins: interval, look-back, overlap, anti, null-tolerant, fallback, blocked containment, pairs in blocks."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimlens.operators.blocking import capped, first_of_two_keys, match_or_contains, pairs_in_blocks
from claimlens.operators.ranking import top_per_group
from claimlens.operators.temporal import day_window_join, lookback_join, month_window_join, months_between, overlap_join, workdays
from claimlens.plans.data import BILL_MONTH, EVENTS, SEGMENTS, SPEND, STATES, bill_month, cents, events, segments, spend, states, table


def interval(spark, sf_dir):
    x = month_window_join(bill_month(spark, sf_dir), events(spark, sf_dir), "npi")
    return x.select("npi", "month_start", "paid_c", "event_dt", months_between("event_dt", "month_start").alias("months_since"))


INTERVAL = f"""WITH {BILL_MONTH}, {EVENTS} SELECT m.npi, month_start, paid_c, event_dt, CAST(date_diff('month', event_dt, month_start) AS INTEGER) AS months_since
FROM bill_month m JOIN events_list e ON m.npi = e.npi AND month_start >= date_trunc('month', event_dt) + INTERVAL 1 MONTH AND (window_end IS NULL OR month_start < date_trunc('month', window_end))"""


def lookback(spark, sf_dir):
    x = lookback_join(bill_month(spark, sf_dir), events(spark, sf_dir), "npi")
    return x.groupBy("npi").agg(F.count("*").alias("months"), F.sum("paid_c").alias("paid_c"), F.max("month_start").alias("last_month"))


LOOKBACK = f"""WITH {BILL_MONTH}, {EVENTS} SELECT m.npi, count(*) AS months, CAST(sum(paid_c) AS BIGINT) AS paid_c, max(month_start) AS last_month
FROM bill_month m JOIN events_list e ON m.npi = e.npi AND month_start >= date_trunc('month', event_dt) - INTERVAL 12 MONTH AND month_start < date_trunc('month', event_dt) GROUP BY 1"""


def overlap(spark, sf_dir):
    ev = events(spark, sf_dir)
    return overlap_join(segments(spark, sf_dir), ev, "npi").select("npi", "segment_id", "start_dt", "end_dt", "event_dt", workdays("start_dt", F.date_add("start_dt", 30)).cast("long").alias("workdays_31"))


OVERLAP = f"""WITH {SEGMENTS}, {EVENTS} SELECT s.npi, segment_id, start_dt, end_dt, event_dt,
  (SELECT count(*) FROM range(0, 31) r(i) WHERE dayofweek(start_dt + CAST(r.i AS INTEGER)) BETWEEN 1 AND 5) AS workdays_31
FROM segments s JOIN events_list e ON s.npi = e.npi AND (end_dt IS NULL OR end_dt > event_dt + INTERVAL 90 DAY) AND (window_end IS NULL OR start_dt < window_end)"""


def day_window(spark, sf_dir):
    """Service days inside (event, end of window], the end included."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("npi"), "l_orderkey", "l_linenumber", F.to_date("l_shipdate").alias("service_dt"))
    return day_window_join(li, events(spark, sf_dir), "npi").groupBy("npi", "tier").agg(F.count("*").alias("n"), F.min("service_dt").alias("first_dt"))


DAY_WINDOW = f"""WITH {EVENTS} SELECT npi, tier, count(*) AS n, CAST(min(l_shipdate) AS DATE) AS first_dt FROM lineitem JOIN events_list ON l_suppkey = npi AND CAST(l_shipdate AS DATE) > event_dt AND (window_end IS NULL OR CAST(l_shipdate AS DATE) <= window_end) GROUP BY 1, 2"""


def cross_state(spark, sf_dir):
    """Pairs of segments of one customer in different states: equality on the customer, inequality tested after."""
    s = segments(spark, sf_dir)
    closed, live = s.where("status_cd = 'F'").alias("t"), s.where("status_cd = 'O'").alias("a")
    x = closed.join(live, (F.col("t.npi") == F.col("a.npi")) & (F.col("t.state") != F.col("a.state")) & (F.col("a.start_dt") > F.col("t.start_dt")))
    return x.groupBy(F.col("t.npi").alias("npi")).agg(F.count("*").alias("pairs"), F.min("a.start_dt").alias("first_active"))


CROSS_STATE = f"""WITH {SEGMENTS} SELECT t.npi, count(*) AS pairs, min(a.start_dt) AS first_active FROM segments t JOIN segments a ON t.npi = a.npi AND t.state <> a.state AND a.start_dt > t.start_dt
WHERE t.status_cd = 'F' AND a.status_cd = 'O' GROUP BY 1"""


def anti(spark, sf_dir):
    """Order and part keys not judged yet: two-key anti-join, and a null-safe NOT IN."""
    li = table(spark, sf_dir, "lineitem")
    judged = li.where("l_returnflag = 'R'").select("l_orderkey", "l_suppkey").distinct()
    small = table(spark, sf_dir, "supplier").where("s_acctbal < 0").select(F.col("s_suppkey").alias("l_suppkey"))
    x = li.join(judged, ["l_orderkey", "l_suppkey"], "left_anti").join(small, "l_suppkey", "left_anti")
    return x.groupBy("l_suppkey").agg(F.count("*").alias("n"))


ANTI = """SELECT l_suppkey, count(*) AS n FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM lineitem j WHERE j.l_returnflag = 'R' AND j.l_orderkey = l.l_orderkey AND j.l_suppkey = l.l_suppkey)
AND l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0) GROUP BY 1"""


def latest_version(spark, sf_dir):
    """The rate in force: the version of the year, else the latest one; ranked once and joined instead of a subquery per row."""
    s = spend(spark, sf_dir)
    rates = s.where("year <= 1998 and minutes % 2 = 0").groupBy("hcpcs", F.col("year").alias("version")).agg(F.max("paid_c").alias("rate_c"))
    last = top_per_group(rates, ["hcpcs"], [F.col("version").desc()]).select("hcpcs", F.col("rate_c").alias("last_c"))
    use = s.groupBy("hcpcs", "year").agg(F.count("*").alias("n"))
    x = use.join(rates.withColumnRenamed("version", "year"), ["hcpcs", "year"], "left").join(last, "hcpcs", "left")
    return x.select("hcpcs", "year", "n", F.coalesce("rate_c", "last_c").alias("rate_c"), F.when(F.col("rate_c").isNotNull(), "version").when(F.col("last_c").isNotNull(), "latest").otherwise("none").alias("basis"))


LATEST_VERSION = f"""WITH {SPEND}, r AS (SELECT hcpcs, year AS version, max(paid_c) AS rate_c FROM spend WHERE year <= 1998 AND minutes % 2 = 0 GROUP BY 1, 2), u AS (SELECT hcpcs, year, count(*) AS n FROM spend GROUP BY 1, 2),
x AS (SELECT u.*, (SELECT rate_c FROM r WHERE r.hcpcs = u.hcpcs AND r.version = u.year LIMIT 1) AS v, (SELECT rate_c FROM r WHERE r.hcpcs = u.hcpcs ORDER BY version DESC LIMIT 1) AS l FROM u)
SELECT hcpcs, year, n, coalesce(v, l) AS rate_c, CASE WHEN v IS NOT NULL THEN 'version' WHEN l IS NOT NULL THEN 'latest' ELSE 'none' END AS basis FROM x"""


def contains(spark, sf_dir):
    """Names that are equal or contain each other within a state, without a nested loop; states may be null on the left."""
    s = states(spark, sf_dir)
    left = s.select("npi", F.regexp_replace("name", "[^A-Za-z0-9]", "").alias("name"), F.when(F.col("npi") % 9 != 0, F.col("state")).alias("state"))
    c = table(spark, sf_dir, "customer")
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    c = c.join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey"))
    # a customer's last digits make names of which some contain others
    right = c.select("c_custkey", F.concat(F.lit("Supplier"), F.lpad(F.col("c_custkey").cast("string"), 9, "0")).alias("rname"), F.col("r_name").alias("rstate"))
    return match_or_contains(left, right, "npi", "c_custkey", "name", "rname", "state", "rstate")


CONTAINS = f"""WITH {STATES}, l AS (SELECT npi, regexp_replace(name, '[^A-Za-z0-9]', '', 'g') AS name, CASE WHEN npi % 9 <> 0 THEN state END AS state FROM states),
r AS (SELECT c_custkey, 'Supplier' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS name, r_name AS state FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
SELECT DISTINCT npi, c_custkey FROM l JOIN r ON (l.state IS NULL OR l.state = r.state) AND (l.name = r.name
  OR (l.state IS NOT NULL AND length(replace(l.name, ' ', '')) >= 8 AND (contains(replace(r.name, ' ', ''), replace(l.name, ' ', '')) OR (length(replace(r.name, ' ', '')) >= 8 AND contains(replace(l.name, ' ', ''), replace(r.name, ' ', ''))))))"""


def block_pairs(spark, sf_dir):
    """Candidate pairs: all within small blocks, the next five by balance in large ones."""
    c = table(spark, sf_dir, "customer").select("c_custkey", cents("c_acctbal").alias("bal_c"), "c_nationkey", "c_mktsegment")
    block = F.when(F.col("c_nationkey") < 5, F.col("c_mktsegment")).otherwise(F.concat(F.col("c_nationkey").cast("string"), F.col("c_mktsegment")))
    return pairs_in_blocks(c, "c_custkey", block, ["bal_c"], most=30)


BLOCK_PAIRS = """WITH c AS (SELECT c_custkey AS u, CAST(round(c_acctbal * 100) AS BIGINT) AS bal_c, CASE WHEN c_nationkey < 5 THEN c_mktsegment ELSE CAST(c_nationkey AS VARCHAR) || c_mktsegment END AS block FROM customer),
x AS (SELECT u, block, row_number() OVER (PARTITION BY block ORDER BY bal_c, u) AS i, count(*) OVER (PARTITION BY block) AS n FROM c)
SELECT DISTINCT p.u AS a, q.u AS b FROM x p JOIN x q ON p.block = q.block AND p.i < q.i AND (p.n <= 30 OR q.i <= p.i + 5)"""


def candidate_cap(spark, sf_dir):
    """Blocking on a computed key; keys with more than three candidates give none."""
    a = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("nation"), F.floor(F.col("s_acctbal") / 1000).cast("long").alias("k"))
    b = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"), F.floor(F.col("c_acctbal") / 1000).cast("long").alias("k"))
    return capped(a.join(b, ["nation", "k"]).select("s_suppkey", "c_custkey"), ["s_suppkey"], 6)


CANDIDATE_CAP = """WITH p AS (SELECT s_suppkey, c_custkey FROM supplier JOIN customer ON s_nationkey = c_nationkey AND floor(s_acctbal / 1000) = floor(c_acctbal / 1000)), n AS (SELECT *, count(*) OVER (PARTITION BY s_suppkey) AS n_cand FROM p)
SELECT * FROM n WHERE n_cand <= 6"""


def two_keys(spark, sf_dir):
    """A label by the strong key, else by the weak one."""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("int").alias("nation"), "c_mktsegment")
    s = table(spark, sf_dir, "supplier").where("s_suppkey % 4 = 0").select(F.col("s_nationkey").cast("int").alias("nation"), F.element_at(F.array(*map(F.lit, ("BUILDING", "MACHINERY", "FURNITURE"))), (F.col("s_suppkey") % 3 + 1).cast("int")).alias("c_mktsegment"), F.col("s_suppkey").alias("label"))
    return first_of_two_keys(c, s, ["nation", "c_mktsegment"], ["nation"], "label")


TWO_KEYS = """WITH s AS (SELECT CAST(s_nationkey AS INTEGER) AS nation, ['BUILDING', 'MACHINERY', 'FURNITURE'][s_suppkey % 3 + 1] AS seg, s_suppkey AS label FROM supplier WHERE s_suppkey % 4 = 0),
a AS (SELECT nation, seg, min(label) AS v FROM s GROUP BY 1, 2), b AS (SELECT nation, min(label) AS v FROM s GROUP BY 1)
SELECT c_custkey, CAST(c_nationkey AS INTEGER) AS nation, c_mktsegment, coalesce(a.v, b.v) AS label, CASE WHEN a.v IS NOT NULL THEN 'high' WHEN b.v IS NOT NULL THEN 'medium' END AS level
FROM customer LEFT JOIN a ON a.nation = c_nationkey AND a.seg = c_mktsegment LEFT JOIN b ON b.nation = c_nationkey"""


def footprint(spark, sf_dir):
    """In either of two lists: a semi-join with their union, and a correlated count made by aggregate and join."""
    c = table(spark, sf_dir, "customer").select("c_custkey")
    o = table(spark, sf_dir, "orders")
    rich = table(spark, sf_dir, "customer").where("c_acctbal > 9000").select("c_custkey")
    late = o.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    n = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n_orders"))
    return c.join(rich.union(late).distinct(), "c_custkey", "left_semi").join(n, "c_custkey", "left").select("c_custkey", F.coalesce("n_orders", F.lit(0)).cast("long").alias("n_orders"))


FOOTPRINT = """SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n_orders FROM customer
WHERE c_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 9000) OR c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')"""

QUERIES = {
    "join_interval": (interval, INTERVAL),
    "join_lookback": (lookback, LOOKBACK),
    "join_overlap": (overlap, OVERLAP),
    "join_day_window": (day_window, DAY_WINDOW),
    "join_cross_state": (cross_state, CROSS_STATE),
    "join_anti": (anti, ANTI),
    "join_latest_version": (latest_version, LATEST_VERSION),
    "join_contains": (contains, CONTAINS),
    "join_block_pairs": (block_pairs, BLOCK_PAIRS),
    "join_candidate_cap": (candidate_cap, CANDIDATE_CAP),
    "join_two_keys": (two_keys, TWO_KEYS),
    "join_footprint": (footprint, FOOTPRINT),
}
