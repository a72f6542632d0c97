"""Scalar functions and key builders over the tables' values."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimlens.functions import casts, keys
from claimlens.operators.similarity import jaro_winkler, similarities
from claimlens.plans.data import cents, r4, table


def dates(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    d = F.to_date("o_orderdate")
    us = F.date_format(d, "M/d/yyyy")
    text = F.when(F.col("o_orderkey") % 3 == 0, us).when(F.col("o_orderkey") % 3 == 1, F.date_format(d, "yyyy-MM-dd")).when(F.col("o_orderkey") % 5 == 0, F.lit("9999-12-30")).otherwise(F.date_format(d, "yyyyMMdd"))
    return o.select("o_orderkey", casts.to_day(text).alias("day"), F.trunc(d, "MM").alias("month"), F.date_format(d, "MMMM d, yyyy").alias("long_text"), (F.dayofweek(d) - 1).cast("long").alias("dow"), F.add_months(d, 11).alias("later"), F.datediff(F.lit("2002-01-01").cast("date"), d).cast("long").alias("age"))


DATES = """SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 AND o_orderkey % 3 <> 1 AND o_orderkey % 5 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS day, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, strftime(o_orderdate, '%B %-d, %Y') AS long_text,
  CAST(dayofweek(o_orderdate) AS BIGINT) AS dow, CAST(CAST(o_orderdate AS DATE) + INTERVAL 11 MONTH AS DATE) AS later, date_diff('day', CAST(o_orderdate AS DATE), DATE '2002-01-01') AS age FROM orders"""


def numbers(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    t = F.when(F.col("c_custkey") % 11 == 0, F.lit("n/a")).otherwise(F.concat((F.col("c_custkey") * 3).cast("string"), F.lit(".25")))
    return c.select(
        "c_custkey", casts.to_long(t).alias("whole"), casts.to_double(t).alias("number"), casts.safe_ratio(F.col("c_custkey"), F.col("c_custkey") % 4).alias("ratio"), F.greatest(F.least(cents("c_acctbal"), F.lit(500000)), F.lit(0)).alias("clamped"),
        r4(F.log10(F.abs(F.col("c_acctbal")) + 1)).alias("log"), F.format_number(F.floor(F.abs("c_acctbal")), 0).alias("text"), casts.yes(F.when(F.col("c_custkey") % 3 == 0, "Y").when(F.col("c_custkey") % 3 == 1, "no")).alias("flag"),
        F.lpad(F.col("c_custkey").cast("string"), 9, "0").alias("padded"), F.concat_ws("; ", F.when(F.col("c_acctbal") < 0, "owes"), F.when(F.col("c_custkey") % 2 == 0, "even")).alias("reasons"),
    )


NUMBERS = """SELECT c_custkey, CASE WHEN c_custkey % 11 <> 0 THEN c_custkey * 3 END AS whole, CASE WHEN c_custkey % 11 <> 0 THEN CAST(c_custkey * 3 AS DOUBLE) + 0.25 END AS number, CAST(c_custkey AS DOUBLE) / nullif(c_custkey % 4, 0) AS ratio,
  greatest(least(CAST(round(c_acctbal * 100) AS BIGINT), 500000), 0) AS clamped, round(log10(abs(c_acctbal) + 1), 4) AS log, format('{:,}', CAST(floor(abs(c_acctbal)) AS BIGINT)) AS text,
  CASE c_custkey % 3 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END AS flag, lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS padded, concat_ws('; ', CASE WHEN c_acctbal < 0 THEN 'owes' END, CASE WHEN c_custkey % 2 = 0 THEN 'even' END) AS reasons FROM customer"""


def npi(spark, sf_dir):
    """Identifiers made of customer keys, and whether their check digit holds."""
    c = table(spark, sf_dir, "customer")
    n = F.concat(F.lit("1"), F.lpad(F.col("c_custkey").cast("string"), 8, "0"), (F.col("c_custkey") % 10).cast("string"))
    return c.select("c_custkey", n.alias("npi"), keys.npi_valid(n).alias("valid"))


NPI = """WITH n AS (SELECT c_custkey, '1' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') || CAST(c_custkey % 10 AS VARCHAR) AS npi FROM customer),
d AS (SELECT *, list_transform(range(1, 10), lambda i: CAST(npi[i] AS INTEGER) * CASE WHEN i % 2 = 1 THEN 2 ELSE 1 END) AS x FROM n)
SELECT c_custkey, npi, (10 - (24 + list_sum(list_transform(x, lambda v: CASE WHEN v > 9 THEN v - 9 ELSE v END))) % 10) % 10 = CAST(npi[10] AS INTEGER) AS valid FROM d"""


def phones_orgs(spark, sf_dir):
    """Phone, organisation and word keys of made-up registry rows."""
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    phone = F.concat(F.when(k % 2 == 0, "1-").otherwise(""), F.lit("("), F.lpad((k % 1000).cast("string"), 3, "0"), F.lit(") "), F.lpad((k * 7919 % 10000000).cast("string"), 7, "0"))
    name = F.concat(F.lit("The "), F.col("c_mktsegment"), F.lit(" Care & Health, "), F.when(k % 3 == 0, "LLC").when(k % 3 == 1, "Inc.").otherwise("Company"))
    agree = keys.names_agree(name, F.col("c_mktsegment"))
    return c.select("c_custkey", keys.phone_key(phone).alias("phone"), keys.org_key(name).alias("org"), keys.list_org_key(name).alias("listed"), keys.name_tokens(name).alias("words"), agree.alias("agree"), F.soundex("c_mktsegment").alias("sound"))


PHONES = r"""WITH c AS (SELECT c_custkey, c_mktsegment, CASE WHEN c_custkey % 2 = 0 THEN '1-' ELSE '' END || '(' || lpad(CAST(c_custkey % 1000 AS VARCHAR), 3, '0') || ') ' || lpad(CAST(c_custkey * 7919 % 10000000 AS VARCHAR), 7, '0') AS phone,
  'The ' || c_mktsegment || ' Care & Health, ' || CASE c_custkey % 3 WHEN 0 THEN 'LLC' WHEN 1 THEN 'Inc.' ELSE 'Company' END AS name FROM customer),
p AS (SELECT *, regexp_replace(phone, '[^0-9]', '', 'g') AS d FROM c), q AS (SELECT *, CASE WHEN length(d) = 11 AND d[1] = '1' THEN substr(d, 2) ELSE d END AS e FROM p)
SELECT c_custkey, CASE WHEN length(e) = 10 AND len(list_distinct(string_split(e, ''))) >= 3 AND e[1:3] NOT IN ('000', '111', '999') THEN e END AS phone, upper(c_mktsegment) || ' CARE HEALTH' AS org,
  trim(regexp_replace(regexp_replace(upper(name), '\b(LLC|INC|INCORPORATED|CORP|CORPORATION|CO|COMPANY|LTD|PC|LP|LLP|PLLC|THE)\b', ' ', 'g'), '[^A-Z0-9 ]| +', ' ', 'g')) AS listed,
  [upper(c_mktsegment)] AS words, TRUE AS agree, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'A351' WHEN 'BUILDING' THEN 'B435' WHEN 'FURNITURE' THEN 'F653' WHEN 'HOUSEHOLD' THEN 'H243' WHEN 'MACHINERY' THEN 'M256' END AS sound FROM q"""


def jw(spark, sf_dir):
    """Similarity of names within a block."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment", F.substring("c_name", 10, 9).alias("a"))
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("c_nationkey"), F.substring("s_name", 10, 9).alias("b"))
    return similarities(c, s, "c_custkey", "s_suppkey", "c_nationkey", "a", "b", lambda a, b: r4(jaro_winkler(a, b)))


JW = """SELECT c_custkey, s_suppkey, round(jaro_winkler_similarity(substr(c_name, 10, 9), substr(s_name, 10, 9)), 4) AS similarity FROM customer JOIN supplier ON c_nationkey = s_nationkey"""


def release_rules(spark, sf_dir):
    """Outcome, tier, amount and topic of release titles."""
    e = table(spark, sf_dir, "events")
    k = F.col("event_id") % 6
    title = F.when(k == 0, F.concat(F.lit("Clinic owner sentenced to repay $"), (F.col("event_id") % 90 + 1).cast("string"), F.lit(" million"))).when(k == 1, "Pharmacist pleads guilty").when(k == 2, "Hospital agrees to pay $12,500").when(k == 3, "Two charged in Medicare scheme").when(k == 4, "Nurse excluded from programs").otherwise("Annual report")
    x = e.select("event_id", title.alias("title"))
    a = keys.action_type("title")
    return x.select("event_id", a.alias("action"), keys.action_tier(a).alias("tier"), keys.largest_dollars("title").alias("dollars"), F.lower("title").rlike(keys.HEALTH_TOPIC).alias("health"))


RELEASE = """SELECT event_id, ['sentenced', 'pleaded_guilty', 'civil_settlement', 'charged', 'exclusion', 'other'][event_id % 6 + 1] AS action, ['adjudicated', 'adjudicated', 'administrative', 'alleged', 'administrative', 'administrative'][event_id % 6 + 1] AS tier,
  CASE event_id % 6 WHEN 0 THEN (event_id % 90 + 1) * 1000000.0::DOUBLE WHEN 2 THEN 12500.0::DOUBLE END AS dollars, event_id % 6 IN (0, 1, 3) AS health FROM events"""


def trigram(spark, sf_dir):
    """Fuzzy search: shared trigrams over all trigrams of both."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    s = keys.trigram_similarity(F.lit("goldenrod lavender spring"), F.col("p_name"))
    return p.select("p_partkey", r4(s).alias("similarity")).where("similarity > 0")


TRIGRAM = """WITH g AS (SELECT p_partkey, list_distinct(flatten(list_transform(list_filter(string_split(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3))))) AS t FROM part),
q AS (SELECT list_distinct(flatten(list_transform(['goldenrod', 'lavender', 'spring'], lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3))))) AS u)
SELECT p_partkey, round(CAST(len(list_intersect(t, u)) AS DOUBLE) / len(list_distinct(list_concat(t, u))), 4) AS similarity FROM g, q WHERE len(list_intersect(t, u)) > 0"""


def arrays_json(spark, sf_dir):
    """Lists filtered, overlapped and joined; a JSON payload that keeps nulls."""
    c = table(spark, sf_dir, "customer")
    det = F.filter(F.array(F.when(F.col("c_custkey") % 2 == 0, "D1"), F.when(F.col("c_custkey") % 3 == 0, "D2"), F.when(F.col("c_custkey") % 5 == 0, "D3")), lambda x: x.isNotNull())
    return c.select("c_custkey", F.array_join(det, ",").alias("detectors"), F.array_contains(det, "D3").alias("has_d3"), F.coalesce(F.arrays_overlap(det, F.array(F.lit("D1"), F.lit("D2"))), F.lit(False)).alias("overlap"), casts.evidence_json(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).alias("segment")).alias("evidence"))


ARRAYS = """WITH d AS (SELECT *, list_filter([CASE WHEN c_custkey % 2 = 0 THEN 'D1' END, CASE WHEN c_custkey % 3 = 0 THEN 'D2' END, CASE WHEN c_custkey % 5 = 0 THEN 'D3' END], lambda x: x IS NOT NULL) AS det FROM customer)
SELECT c_custkey, coalesce(array_to_string(det, ','), '') AS detectors, list_contains(det, 'D3') AS has_d3, list_has_any(det, ['D1', 'D2']) AS overlap, CAST(to_json({'id': c_custkey, 'segment': CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END}) AS VARCHAR) AS evidence FROM d"""

QUERIES = {
    "fn_dates": (dates, DATES),
    "fn_numbers": (numbers, NUMBERS),
    "fn_npi_check_digit": (npi, NPI),
    "fn_phone_org_keys": (phones_orgs, PHONES),
    "fn_jaro_winkler": (jw, JW),
    "fn_release_rules": (release_rules, RELEASE),
    "fn_trigram_similarity": (trigram, TRIGRAM),
    "fn_arrays_json": (arrays_json, ARRAYS),
}
