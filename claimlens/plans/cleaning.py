"""Warehouse build: typed projection, drop counts, totals, unions, home state, role de-duplication."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimlens.operators.ranking import top_per_group
from claimlens.plans.data import BILL_MONTH, SEGMENTS, SPEND, bill_month, cents, segments, spend, table


def typed_projection(spark, sf_dir):
    """Rename, cast and filter at the scan: ranges and lists reach the Parquet reader, the pattern is tested after."""
    p = table(spark, sf_dir, "part")
    p = p.where(F.col("p_size").between(5, 40) & ~F.col("p_brand").isin("Brand#11", "Brand#55") & F.col("p_brand").rlike("^Brand#[0-9]{2}$") & ~F.col("p_type").like("%DARD") & ~F.col("p_name").ilike("RED%") & ~F.col("p_name").startswith("blue"))
    return p.drop("p_name").select(F.col("p_partkey").alias("part_id"), F.substring("p_brand", 7, 2).try_cast("int").alias("brand_no"), F.upper(F.trim("p_type")).alias("family"), F.nullif("p_size", F.lit(10)).cast("int").alias("size_or_null"))


TYPED_PROJECTION = """SELECT p_partkey AS part_id, TRY_CAST(substr(p_brand, 7, 2) AS INTEGER) AS brand_no, upper(trim(p_type)) AS family, CAST(nullif(p_size, 10) AS INTEGER) AS size_or_null
FROM part WHERE p_size BETWEEN 5 AND 40 AND p_brand NOT IN ('Brand#11', 'Brand#55') AND regexp_matches(p_brand, '^Brand#[0-9]{2}$') AND p_type NOT LIKE '%DARD' AND p_name NOT ILIKE 'RED%' AND NOT starts_with(p_name, 'blue')"""


def semi_join_filter(spark, sf_dir):
    """Facts of listed codes only: a semi-join with a small list."""
    listed = table(spark, sf_dir, "part").where("p_size <= 5").select("p_partkey")
    li = table(spark, sf_dir, "lineitem")
    return li.join(listed, li.l_partkey == listed.p_partkey, "left_semi").groupBy("l_returnflag").agg(F.count("*").alias("n"), F.sum(cents("l_extendedprice")).alias("paid_c"))


SEMI_JOIN_FILTER = """SELECT l_returnflag, count(*) AS n, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS paid_c
FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size <= 5) GROUP BY 1"""


def drop_counts(spark, sf_dir):
    """Rows that each cleaning rule drops: one scan with conditional counts, then unpivoted."""
    li = table(spark, sf_dir, "lineitem")
    rules = {"large_discount": "l_discount > 0.09", "no_tax": "l_tax = 0", "late": "l_shipdate >= timestamp'2001-01-01'", "single": "l_quantity = 1", "kept": "not (l_discount > 0.09 or l_tax = 0 or l_shipdate >= timestamp'2001-01-01' or l_quantity = 1)"}
    one = li.agg(F.count("*").alias("all"), *(F.count_if(F.expr(r)).alias(k) for k, r in rules.items()))
    pairs = ", ".join(f"'{k}', `{k}`" for k in ("all", *rules))
    return one.selectExpr(f"stack({len(rules) + 1}, {pairs}) as (reason, n)")


DROP_COUNTS = """WITH c AS (SELECT count(*) AS a, count(*) FILTER (WHERE l_discount > 0.09) AS b, count(*) FILTER (WHERE l_tax = 0) AS c, count(*) FILTER (WHERE l_shipdate >= TIMESTAMP '2001-01-01') AS d,
  count(*) FILTER (WHERE l_quantity = 1) AS e, count(*) FILTER (WHERE NOT (l_discount > 0.09 OR l_tax = 0 OR l_shipdate >= TIMESTAMP '2001-01-01' OR l_quantity = 1)) AS f FROM lineitem)
SELECT 'all' AS reason, a AS n FROM c UNION ALL SELECT 'large_discount', b FROM c UNION ALL SELECT 'no_tax', c FROM c UNION ALL SELECT 'late', d FROM c UNION ALL SELECT 'single', e FROM c UNION ALL SELECT 'kept', f FROM c"""


def spend_totals(spark, sf_dir):
    """Billing by year, with the month kept as text beside the date."""
    s = spend(spark, sf_dir)
    return s.groupBy("npi", "year").agg(F.sum("paid_c").alias("paid_c"), F.sum("lines").alias("lines"), F.max("patients").alias("max_patients"), F.min(F.date_format("month_start", "yyyy-MM")).alias("first_month"), F.countDistinct("hcpcs").alias("n_codes"))


SPEND_TOTALS = f"""WITH {SPEND} SELECT npi, year, CAST(sum(paid_c) AS BIGINT) AS paid_c, CAST(sum(lines) AS BIGINT) AS lines, max(patients) AS max_patients, min(strftime(month_start, '%Y-%m')) AS first_month, count(DISTINCT hcpcs) AS n_codes FROM spend GROUP BY ALL"""


def union_by_name(spark, sf_dir):
    """Registries with different columns, aligned by name; missing ones are null."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_nationkey").cast("int").alias("nation"))
    return c.unionByName(s, allowMissingColumns=True)


UNION_BY_NAME = """SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment, CAST(NULL AS INTEGER) AS nation FROM customer
UNION ALL BY NAME SELECT s_suppkey AS id, s_name AS name, CAST(s_nationkey AS INTEGER) AS nation FROM supplier"""


def home_state(spark, sf_dir):
    """The state with the most enrolled days; open segments end on 2002-01-01; ties go to the smaller state."""
    s = segments(spark, sf_dir)
    days = s.groupBy("npi", "state").agg(F.sum(F.datediff(F.coalesce("end_dt", F.lit("2002-01-01").cast("date")), "start_dt")).alias("days"))
    return top_per_group(days, ["npi"], [F.col("days").desc(), F.col("state")])


HOME_STATE = f"""WITH {SEGMENTS}, d AS (SELECT npi, state, CAST(sum(date_diff('day', start_dt, coalesce(end_dt, DATE '2002-01-01'))) AS BIGINT) AS days FROM segments GROUP BY 1, 2)
SELECT npi, state, days FROM d QUALIFY row_number() OVER (PARTITION BY npi ORDER BY days DESC, state) = 1"""


def role_dedupe(spark, sf_dir):
    """Months paid in either role, counted once: billing plus servicing minus what is both."""
    s = spend(spark, sf_dir)
    keys = ["npi", "month_start"]
    bill = s.groupBy(*keys).agg(F.sum("paid_c").alias("bill_c"))
    srv = s.groupBy((F.col("servicing") % 100).alias("npi"), "month_start").agg(F.sum("paid_c").alias("srv_c"))
    own = s.where("npi = servicing % 100").groupBy(*keys).agg(F.sum("paid_c").alias("self_c"))
    x = bill.join(srv, keys, "full_outer").join(own, keys, "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return x.select(*keys, (zero("bill_c") + zero("srv_c") - zero("self_c")).alias("paid_c"), zero("bill_c").alias("as_billing_c"), zero("srv_c").alias("as_servicing_c"))


ROLE_DEDUPE = f"""WITH {SPEND}, b AS (SELECT npi, month_start, CAST(sum(paid_c) AS BIGINT) AS v FROM spend GROUP BY 1, 2), s AS (SELECT servicing % 100 AS npi, month_start, CAST(sum(paid_c) AS BIGINT) AS v FROM spend GROUP BY 1, 2),
o AS (SELECT npi, month_start, CAST(sum(paid_c) AS BIGINT) AS v FROM spend WHERE npi = servicing % 100 GROUP BY 1, 2)
SELECT npi, month_start, coalesce(b.v, 0) + coalesce(s.v, 0) - coalesce(o.v, 0) AS paid_c, coalesce(b.v, 0) AS as_billing_c, coalesce(s.v, 0) AS as_servicing_c
FROM b FULL OUTER JOIN s USING (npi, month_start) LEFT JOIN o USING (npi, month_start)"""


def monthly(spark, sf_dir):
    return bill_month(spark, sf_dir)


def html_links(spark, sf_dir):
    """Pages parsed by patterns: language, number of links, script-free text length."""
    h = table(spark, sf_dir, "pages")
    links = F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))
    text = F.regexp_replace(F.regexp_replace("html", "(?s)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>", " "), "<[^>]*>", " ")
    text = F.trim(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " "))
    return h.select("page_id", F.regexp_extract("html", '<html lang="([a-z]+)"', 1).alias("lang"), F.size(links).cast("long").alias("n_links"), F.length(text).cast("long").alias("n_chars"))


HTML_LINKS = r"""SELECT page_id, regexp_extract(html, '<html lang="([a-z]+)"', 1) AS lang, CAST(len(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS BIGINT) AS n_links,
  CAST(length(trim(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '[\x20\x09-\x0D]+', ' ', 'g'))) AS BIGINT) AS n_chars FROM pages"""


def nested_json(spark, sf_dir):
    """Nested JSON text to typed columns: parse with a declared schema, then project."""
    e = table(spark, sf_dir, "events")
    parsed = F.from_json("props", "k int")
    return e.select("event_type", parsed["k"].alias("k"), "value").groupBy("event_type").agg(F.count("*").alias("n"), F.sum("k").alias("sum_k"), F.max("k").alias("max_k"))


NESTED_JSON = """SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract_string(props, '$.k') AS INTEGER)) AS BIGINT) AS sum_k, max(CAST(json_extract_string(props, '$.k') AS INTEGER)) AS max_k FROM events GROUP BY 1"""

QUERIES = {
    "clean_typed_projection": (typed_projection, TYPED_PROJECTION),
    "clean_semi_join_filter": (semi_join_filter, SEMI_JOIN_FILTER),
    "clean_drop_counts": (drop_counts, DROP_COUNTS),
    "clean_spend_totals": (spend_totals, SPEND_TOTALS),
    "clean_union_by_name": (union_by_name, UNION_BY_NAME),
    "clean_home_state": (home_state, HOME_STATE),
    "clean_role_dedupe": (role_dedupe, ROLE_DEDUPE),
    "clean_monthly": (monthly, f"WITH {BILL_MONTH} SELECT npi, month_start, paid_c, lines, CAST(n AS BIGINT) AS n FROM bill_month"),
    "clean_html_parse": (html_links, HTML_LINKS),
    "clean_nested_json": (nested_json, NESTED_JSON),
}
