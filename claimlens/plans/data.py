"""The registered queries' view of the tables: provider-payment facts, list events, enrolment segments and registry rows
derived from the test tables, once as DataFrames and once as the SQL that mirrors them.

npi is the supplier key, servicing the customer key, state the region of the supplier, hcpcs the part's brand, family
its type, minutes its size, month the month of shipment, paid the extended price in whole cents. A list event is a
supplier's first returned shipment; its window ends 18 months later for even keys. Money is summed as whole cents, so
no result depends on the order of a sum."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimlens.operators.temporal import month_of


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cents(c) -> Column:
    return F.round(F.col(c) * 100 if isinstance(c, str) else c * 100).cast("long")


def r4(c: Column) -> Column:
    return F.round(c, 4)


def r4_scaled(c: Column) -> Column:
    """Four digits as DuckDB rounds them: of the product with 10,000, in which a tie can become none, or arise. Spark's
    own round goes by the shortest decimal that stands for the number."""
    return F.round(c * 1e4) / 1e4


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """npi, state, nation, entity_type, name, taxonomy, enum_date of suppliers."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    s = table(spark, sf_dir, "supplier").join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey")).join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey"))
    key = F.col("s_suppkey")
    return s.select(
        key.alias("npi"), F.col("r_name").alias("state"), F.col("n_name").alias("nation"), F.when(key % 3 == 0, "2").otherwise("1").alias("entity_type"), F.col("s_name").alias("name"),
        F.concat(F.lit("T"), (key % 4).cast("string")).alias("taxonomy"), F.date_add(F.lit("1994-01-01").cast("date"), ((key * 37) % 2500).cast("int")).alias("enum_date"), F.col("s_acctbal").alias("balance"),
    )


STATES = """states AS (
  SELECT s_suppkey AS npi, r_name AS state, n_name AS nation, CASE WHEN s_suppkey % 3 = 0 THEN '2' ELSE '1' END AS entity_type, s_name AS name,
    'T' || CAST(s_suppkey % 4 AS VARCHAR) AS taxonomy, DATE '1994-01-01' + CAST((s_suppkey * 37) % 2500 AS INTEGER) AS enum_date, s_acctbal AS balance
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
)"""


def spend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claim lines: npi, servicing, hcpcs, family, minutes, month_start, year, lines, paid_c, patients, charge_c, allowed_c."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("servicing"))
    df = lines(spark, sf_dir)
    return df.join(orders, df.l_orderkey == orders.o_orderkey).drop("l_orderkey", "o_orderkey")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """spend without servicing, but with l_orderkey: an inner join can't be pruned, so who needs no orders reads none."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice", "l_linenumber", "l_tax", "l_discount")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", "p_size")
    df = li.join(part, li.l_partkey == part.p_partkey)
    return df.select(
        "l_orderkey", F.col("l_suppkey").alias("npi"), F.col("p_brand").alias("hcpcs"), F.col("p_type").alias("family"), F.col("p_size").cast("int").alias("minutes"),
        month_of("l_shipdate").alias("month_start"), F.year("l_shipdate").alias("year"), F.col("l_quantity").cast("long").alias("lines"), cents("l_extendedprice").alias("paid_c"), F.col("l_linenumber").cast("int").alias("patients"),
        cents(F.col("l_extendedprice") * (1 + F.col("l_tax"))).alias("charge_c"), cents(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("allowed_c"),
    )


SPEND = """spend AS (
  SELECT l_suppkey AS npi, o_custkey AS servicing, p_brand AS hcpcs, p_type AS family, CAST(p_size AS INTEGER) AS minutes,
    CAST(date_trunc('month', l_shipdate) AS DATE) AS month_start, CAST(year(l_shipdate) AS INTEGER) AS year, CAST(l_quantity AS BIGINT) AS lines,
    CAST(round(l_extendedprice * 100) AS BIGINT) AS paid_c, CAST(l_linenumber AS INTEGER) AS patients,
    CAST(round(l_extendedprice * (1 + l_tax) * 100) AS BIGINT) AS charge_c, CAST(round(l_extendedprice * (1 - l_discount) * 100) AS BIGINT) AS allowed_c
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey
)"""


def bill_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """npi by month: paid_c, lines, n."""
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice")
    return li.groupBy(F.col("l_suppkey").alias("npi"), month_of("l_shipdate").alias("month_start")).agg(F.sum(cents("l_extendedprice")).alias("paid_c"), F.sum(F.col("l_quantity").cast("long")).alias("lines"), F.count("*").alias("n"))


BILL_MONTH = """bill_month AS (
  SELECT l_suppkey AS npi, CAST(date_trunc('month', l_shipdate) AS DATE) AS month_start,
    CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS paid_c, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS lines, count(*) AS n
  FROM lineitem GROUP BY 1, 2
)"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """npi, event_dt, window_end (null for odd keys), tier."""
    li = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'")
    first = li.groupBy(F.col("l_suppkey").alias("npi")).agg(F.to_date(F.min("l_shipdate")).alias("event_dt"))
    end = F.when(F.col("npi") % 2 == 0, F.add_months("event_dt", 18))
    return first.select("npi", "event_dt", end.alias("window_end"), F.when(F.col("npi") % 3 == 0, "A").when(F.col("npi") % 3 == 1, "B").otherwise("C").alias("tier"))


EVENTS = """events_list AS (
  SELECT npi, event_dt, CASE WHEN npi % 2 = 0 THEN CAST(event_dt + INTERVAL 18 MONTH AS DATE) END AS window_end,
    CASE npi % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'C' END AS tier
  FROM (SELECT l_suppkey AS npi, CAST(min(l_shipdate) AS DATE) AS event_dt FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
)"""


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Enrolment segments of customers: npi, state, start_dt, end_dt (null for finished orders), status_cd, segment_id."""
    o = table(spark, sf_dir, "orders")
    days = F.pmod(F.floor("o_totalprice").cast("long"), F.lit(700)).cast("int")
    start = F.to_date("o_orderdate")
    return o.select(F.col("o_custkey").alias("npi"), (F.col("o_orderkey") % 50).alias("state"), start.alias("start_dt"), F.when(F.col("o_orderstatus") != "F", F.date_add(start, days)).alias("end_dt"), F.col("o_orderstatus").alias("status_cd"), F.col("o_orderkey").alias("segment_id"))


SEGMENTS = """segments AS (
  SELECT o_custkey AS npi, o_orderkey % 50 AS state, CAST(o_orderdate AS DATE) AS start_dt,
    CASE WHEN o_orderstatus <> 'F' THEN CAST(o_orderdate AS DATE) + CAST(CAST(floor(o_totalprice) AS BIGINT) % 700 AS INTEGER) END AS end_dt,
    o_orderstatus AS status_cd, o_orderkey AS segment_id
  FROM orders
)"""


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Releases resolved to numbers: urgent orders, of a customer each."""
    o = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'")
    k = F.col("o_orderkey")
    names = lambda by, *words: F.element_at(F.array(*map(F.lit, words)), (k % by + 1).cast("int"))
    return o.select(
        F.col("o_custkey").alias("npi"), F.concat(F.lit("r"), k.cast("string")).alias("source_id"), names(3, "DOJ", "OIG", "OIG").alias("source"), names(4, "adjudicated", "alleged", "administrative", "alleged").alias("tier"),
        names(4, "pleaded_guilty", "charged", "civil_settlement", "indicted").alias("action_type"), F.to_date("o_orderdate").alias("event_dt"), (F.col("o_custkey") % 50).cast("string").alias("state"), F.concat(F.lit("PARTY "), (k % 7).cast("string")).alias("name"),
        F.concat(F.lit("Release "), k.cast("string")).alias("title"), F.concat(F.lit("https://r.example/"), k.cast("string")).alias("url"), (k % 5 != 0).alias("same_entity"), names(7, "low", *["high"] * 6).alias("confidence"), F.when(k % 9 < 7, k % 9 != 0).alias("is_subject"),
    )


def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'")
    return o.select(F.concat(F.lit("r"), F.col("o_orderkey").cast("string")).alias("source_id"), F.when(F.col("o_orderkey") % 6 == 0, "State Enforcement Agencies").when(F.col("o_orderkey") % 6 < 5, "Criminal").alias("category"))


MATCHES = """matches AS (
  SELECT o_custkey AS npi, 'r' || o_orderkey AS source_id, ['DOJ', 'OIG', 'OIG'][o_orderkey % 3 + 1] AS source, ['adjudicated', 'alleged', 'administrative', 'alleged'][o_orderkey % 4 + 1] AS tier,
    ['pleaded_guilty', 'charged', 'civil_settlement', 'indicted'][o_orderkey % 4 + 1] AS action_type, CAST(o_orderdate AS DATE) AS event_dt, CAST(o_custkey % 50 AS VARCHAR) AS state, 'PARTY ' || o_orderkey % 7 AS name,
    'Release ' || o_orderkey AS title, 'https://r.example/' || o_orderkey AS url, o_orderkey % 5 <> 0 AS same_entity, CASE WHEN o_orderkey % 7 = 0 THEN 'low' ELSE 'high' END AS confidence, CASE WHEN o_orderkey % 9 < 7 THEN o_orderkey % 9 <> 0 END AS is_subject
  FROM orders WHERE o_orderpriority = '1-URGENT'
), actions AS (
  SELECT 'r' || o_orderkey AS source_id, CASE WHEN o_orderkey % 6 = 0 THEN 'State Enforcement Agencies' WHEN o_orderkey % 6 < 5 THEN 'Criminal' END AS category FROM orders WHERE o_orderpriority = '1-URGENT'
)"""
