"""List events over the tables: three lists made of returned shipments, partial orders and negative balances."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimlens.operators import listed as d3
from claimlens.plans.data import BILL_MONTH, EVENTS, MATCHES, SEGMENTS, STATES, actions, bill_month, events, matches, r4, segments, states, table
from claimlens.session import materialize


def _events(spark, sf_dir):
    e = events(spark, sf_dir)
    reg = states(spark, sf_dir).select("npi", F.concat(F.col("nation"), F.lit(" CLINIC")).alias("name"))
    a = e.select("npi", F.lit("RETURNS").alias("source"), "event_dt", "window_end", F.concat(F.lit("tier "), "tier").alias("reason"), "tier", F.lit(None).cast("string").alias("source_name"))
    b = states(spark, sf_dir).where("balance < 3000").select("npi", F.lit("BALANCE").alias("source"), F.date_add(F.lit("1997-01-15").cast("date"), (F.col("npi") % 700).cast("int")).alias("event_dt"), F.lit(None).cast("date").alias("window_end"), F.lit("low balance").alias("reason"), F.lit("A").alias("tier"), F.concat(F.lit("The "), F.when(F.col("npi") % 4 == 0, "OTHER").otherwise(F.col("nation")), F.lit(" Group Inc")).alias("source_name"))
    return d3.list_events([a, b, a], reg, F.col("npi") >= 0)


EV = f"""{EVENTS}, {STATES}, ev0 AS (SELECT npi, 'RETURNS' AS source, event_dt, window_end, 'tier ' || tier AS reason, tier, CAST(NULL AS VARCHAR) AS source_name FROM events_list
  UNION SELECT npi, 'BALANCE', DATE '1997-01-15' + CAST(npi % 700 AS INTEGER), NULL, 'low balance', 'A', CASE WHEN npi % 4 = 0 THEN 'OTHER' ELSE nation END FROM states WHERE balance < 3000),
ev AS (SELECT ev0.* EXCLUDE (source_name, tier), CASE WHEN source_name <> nation THEN 'C' ELSE tier END AS tier, nation || ' CLINIC' AS registry_name, CASE WHEN source_name IS NOT NULL THEN source_name = nation END AS name_agrees,
  CASE WHEN source_name IS NULL THEN 'exact_npi_unnamed_source' WHEN source_name = nation THEN 'exact_npi_name_verified' ELSE 'exact_npi_name_conflict' END AS id_match FROM ev0 JOIN states USING (npi))"""


def list_events(spark, sf_dir):
    return _events(spark, sf_dir).select("npi", "source", "event_dt", "window_end", "reason", "tier", "registry_name", "name_agrees", "id_match")


LIST_EVENTS = f"WITH {EV} SELECT npi, source, event_dt, window_end, reason, tier, registry_name, name_agrees, id_match FROM ev"


def _after(spark, sf_dir):
    # both are read by the months after an event and by those before it
    x = d3.paid_after(materialize(bill_month(spark, sf_dir), "bill-months"), materialize(_events(spark, sf_dir), "list-events"))
    return x.withColumn("score", r4(d3.paid_after_score(F.col("tier"), F.col("after_c") / 100, F.col("months_after"), F.col("before_c"))))


AFTER_CTE = f"""{BILL_MONTH}, {EV}, a AS (SELECT npi, source, event_dt, window_end, reason, tier, count(*) AS months_after, min(month_start) AS first_month, max(month_start) AS last_month, CAST(sum(paid_c) AS BIGINT) AS after_c
  FROM ev JOIN bill_month USING (npi) WHERE month_start >= date_trunc('month', event_dt) + INTERVAL 1 MONTH AND (window_end IS NULL OR month_start < date_trunc('month', window_end)) GROUP BY ALL),
b AS (SELECT npi, source, event_dt, count(*) AS months_before, CAST(sum(paid_c) AS BIGINT) AS before_c FROM (SELECT DISTINCT npi, source, event_dt FROM ev) JOIN bill_month USING (npi)
  WHERE month_start >= date_trunc('month', event_dt) - INTERVAL 12 MONTH AND month_start < date_trunc('month', event_dt) GROUP BY ALL),
pa AS (SELECT a.*, coalesce(months_before, 0) AS months_before, coalesce(before_c, 0) AS before_c,
  round(CASE WHEN tier = 'A' THEN 2.0::DOUBLE ELSE 0 END + log10(after_c / 100 + 1) + CASE WHEN months_after >= 6 THEN 1 ELSE 0 END + CASE WHEN coalesce(before_c, 0) > 0 THEN 0.5::DOUBLE ELSE 0 END, 4) AS score FROM a LEFT JOIN b USING (npi, source, event_dt)
  QUALIFY row_number() OVER (PARTITION BY npi, source, event_dt ORDER BY tier, after_c DESC, reason) = 1)"""


def after(spark, sf_dir):
    return _after(spark, sf_dir)


def enrolled(spark, sf_dir):
    ev = _events(spark, sf_dir)
    return d3.enrolled_after(segments(spark, sf_dir).where("status_cd = 'O'"), ev, "2002-01-01")


ENROLLED = f"""WITH {EV}, {SEGMENTS}, s AS (SELECT * REPLACE (coalesce(end_dt, DATE '2002-01-01') AS end_dt) FROM segments WHERE status_cd = 'O')
SELECT npi, source, event_dt, tier, state, status_cd, min(start_dt) AS seg_start, max(end_dt) AS seg_end, CAST(date_diff('day', event_dt, max(end_dt)) AS INTEGER) AS days_active FROM ev JOIN s USING (npi)
WHERE end_dt > event_dt + INTERVAL 90 DAY AND (window_end IS NULL OR start_dt < window_end) GROUP BY npi, source, event_dt, tier, state, status_cd"""


def cross(spark, sf_dir):
    s = segments(spark, sf_dir).withColumn("state", F.col("state") % 6)
    return d3.cross_state(s, ["P", "F"], ["O"], "2002-01-01", 0.40, 90, 5)


CROSS = f"""WITH {SEGMENTS}, s AS (SELECT npi, state % 6 AS state, start_dt, coalesce(end_dt, DATE '2002-01-01') AS e, status_cd, segment_id FROM segments),
l AS (SELECT npi, state, status_cd FROM s QUALIFY row_number() OVER (PARTITION BY npi, state ORDER BY start_dt DESC, e DESC, segment_id) = 1),
k AS (SELECT state, status_cd FROM (SELECT state, status_cd, count(*) / sum(count(*)) OVER (PARTITION BY state) AS share FROM s GROUP BY 1, 2) WHERE share <= 0.40::DOUBLE),
t AS (SELECT npi, state AS term_state, status_cd AS term_code, min(start_dt) AS term_dt FROM s JOIN l USING (npi, state, status_cd) JOIN k USING (state, status_cd) WHERE status_cd IN ('P', 'F') GROUP BY 1, 2, 3),
a AS (SELECT npi, state AS active_state, min(start_dt) AS active_start, max(e) AS active_end FROM s WHERE status_cd = 'O' GROUP BY 1, 2), f AS (SELECT npi, count(DISTINCT state) AS n_states FROM s GROUP BY 1 HAVING n_states <= 5)
SELECT npi, term_state, term_code, term_dt, active_state, active_start, active_end, n_states FROM t JOIN a USING (npi) JOIN f USING (npi) WHERE active_state <> term_state AND active_end > term_dt + INTERVAL 90 DAY"""


def providers(spark, sf_dir):
    return d3.provider_rollup(_events(spark, sf_dir))


PROVIDERS = f"""WITH {EV} SELECT npi, min(event_dt) AS first_event_dt, string_agg(DISTINCT source, ',' ORDER BY source) AS sources, count(DISTINCT source) AS n_sources, bool_and(coalesce(name_agrees, TRUE)) AS names_agree,
  CASE WHEN bool_and(id_match = 'exact_npi_name_verified') THEN 'exact_npi_name_verified' ELSE string_agg(DISTINCT id_match, ',' ORDER BY id_match) END AS id_match, CASE WHEN NOT bool_or(window_end IS NULL) THEN max(window_end) END AS window_end FROM ev GROUP BY 1"""


def flags(spark, sf_dir):
    """Flags without their id, which is a hash that only this engine computes."""
    x = _after(spark, sf_dir).where("tier = 'A' and after_c > 0").withColumn("dollars", F.col("after_c") / 100)
    return d3.flags(x, "D3", "paid_after", "months_after", 1.0, "score", "dollars", ["npi", "source", "event_dt", "window_end", "months_after"]).drop("id")


FLAGS = f"""WITH {AFTER_CTE} SELECT 'D3' AS detector, npi, 'paid_after' AS metric, CAST(months_after AS DOUBLE) AS value, 1.0::DOUBLE AS threshold, score, after_c / 100 AS dollars, tier,
  CAST(to_json({{'npi': npi, 'source': source, 'event_dt': CAST(event_dt AS VARCHAR), 'window_end': CAST(window_end AS VARCHAR), 'months_after': months_after}}) AS VARCHAR) AS evidence FROM pa WHERE tier = 'A' AND after_c > 0"""


def summary(spark, sf_dir):
    """Counts, dollars and quantiles by list and tier."""
    return _after(spark, sf_dir).groupBy("source", "tier").agg(F.count("*").alias("n"), F.countDistinct("npi").alias("n_npi"), F.sum("after_c").alias("after_c"), F.median("months_after").alias("med_months"), F.min("first_month").alias("first_month"))


SUMMARY = f"WITH {AFTER_CTE} SELECT source, tier, count(*) AS n, count(DISTINCT npi) AS n_npi, CAST(sum(after_c) AS BIGINT) AS after_c, median(months_after) AS med_months, min(first_month) AS first_month FROM pa GROUP BY 1, 2"

def _day(first: str, spread: int, step: int = 1):
    return F.date_add(F.lit(first).cast("date"), (F.col("c_custkey") * step % spread).cast("int"))


def nine_sources(spark, sf_dir):
    """The events of all nine kinds of list, made of customers and orders, with their identity checks."""
    c = table(spark, sf_dir, "customer")
    k, seg = F.col("c_custkey"), F.col("c_mktsegment")
    who = (k.alias("npi"), F.col("c_nationkey").cast("string").alias("state"), F.when(k % 13 == 0, "OTHER PERSON").otherwise(F.concat(seg, F.lit(" INC"))).alias("name"), seg.alias("kind"))
    every = lambda n, c, t="date": F.when(k % n == 0, c).cast(t)
    registry = c.where("c_custkey % 17 <> 0").select(who[0], who[1], F.concat(F.lit("PROVIDER "), seg, F.lit(" CLINIC")).alias("name"), F.when(k % 3 == 0, "2").otherwise("1").alias("entity_type"), every(5, _day("1996-06-01", 300)).alias("deact_dt"), every(10, _day("1996-09-01", 400, 7)).alias("react_dt"), seg.alias("taxonomy"))
    revoked = c.where("c_custkey % 4 = 0").select(*who, _day("1995-01-01", 900).alias("revoked_dt"), every(8, _day("1999-01-01", 900)).alias("reenroll_bar_dt"), F.concat(F.lit("424.535(A)("), (k % 23 + 1).cast("string"), F.lit(") GROUND")).alias("reason"))
    leie = c.where("c_custkey % 6 = 1").select(*who, _day("1994-01-01", 1500).alias("excl_dt"), every(5, _day("1999-01-01", 500)).alias("rein_dt"), F.when(k % 12 == 1, F.lit("1999-01-01")).cast("date").alias("waiver_dt"), F.concat(F.lit("1128a"), (k % 4).cast("string")).alias("excltype"), F.when(k % 5 != 0, seg).alias("general"))
    state = c.where("c_custkey % 7 = 2").select(who[0], who[2], who[3], F.when(k % 2 == 0, "TX").otherwise("CA").alias("state"), _day("2017-01-01", 730).alias("excl_dt"), every(3, F.lit("2019-01-01")).alias("reinstated_dt"), every(4, F.lit("2020-01-01")).alias("eligible_dt"), F.lit("State list").alias("list"))
    sam = c.where("c_custkey % 9 = 3").select(*who, F.element_at(F.array(F.lit("HHS"), F.lit("OPM"), F.lit(None).cast("string")), (k % 3 + 1).cast("int")).alias("agency"), _day("1995-01-01", 900).alias("active_dt"), every(2, F.lit("2001-01-01")).alias("termination_dt"), F.lit("Ineligible").alias("exclusion_type"), F.when(k % 5 != 0, "Z1").alias("code"))
    o = table(spark, sf_dir, "orders")
    code = F.element_at(F.array(*map(F.lit, ("80", "60", "62", "02", "03", "80", "99", "71", "04", "05"))), (F.col("o_orderkey") % 10 + 1).cast("int"))
    enroll = segments(spark, sf_dir).drop("status_cd").join(o.select(F.col("o_orderkey").alias("segment_id"), code.alias("status_cd")), "segment_id")
    enroll = enroll.withColumn("state", F.col("state").cast("string")).withColumn("status_desc", F.concat(F.lit("S"), "status_cd")).withColumn("kind", F.lit("K"))
    named = c.where("c_custkey % 11 = 4").select(*who, F.lit("SAM").alias("list"), _day("1996-01-01", 500).alias("event_dt"), F.when(k % 5 != 0, "Ineligible").alias("exclusion_type"), (k % 2 == 0).alias("same_entity"), F.when(k % 3 != 0, "high").otherwise("low").alias("confidence"))
    enroll = materialize(enroll, "list-segments")
    lists = [d3.revoked(revoked), d3.excluded(leie), d3.state_excluded(state), d3.debarred(sam), d3.deactivated(registry), d3.deceased(enroll, registry, "1995-01-01"), d3.terminated(enroll), d3.matched_by_name(named), d3.released(matches(spark, sf_dir), actions(spark, sf_dir))]
    return d3.list_events(lists, registry).drop("registry_name")


NINE = f"""WITH {SEGMENTS}, {MATCHES}, c AS (SELECT c_custkey AS k, c_custkey AS npi, CAST(c_nationkey AS VARCHAR) AS state, CASE WHEN c_custkey % 13 = 0 THEN 'OTHER PERSON' ELSE c_mktsegment || ' INC' END AS name, c_mktsegment AS kind FROM customer),
reg AS (SELECT npi, state, CASE WHEN k % 3 = 0 THEN '2' ELSE '1' END AS entity_type, CASE WHEN k % 5 = 0 THEN DATE '1996-06-01' + CAST(k % 300 AS INTEGER) END AS deact_dt, CASE WHEN k % 10 = 0 THEN DATE '1996-09-01' + CAST(k * 7 % 400 AS INTEGER) END AS react_dt, kind FROM c WHERE k % 17 <> 0),
en AS (SELECT npi, CAST(state AS VARCHAR) AS state, start_dt, end_dt, segment_id, ['80', '60', '62', '02', '03', '80', '99', '71', '04', '05'][segment_id % 10 + 1] AS cd FROM segments),
lt AS (SELECT npi, state, cd FROM en QUALIFY row_number() OVER (PARTITION BY npi, state ORDER BY start_dt DESC, coalesce(end_dt, DATE '9999-01-01') DESC, segment_id) = 1),
rel AS (SELECT m.*, category FROM matches m JOIN actions USING (source_id) WHERE same_entity AND confidence = 'high' AND coalesce(is_subject, TRUE) QUALIFY row_number() OVER (PARTITION BY npi, tier, event_dt ORDER BY CASE source WHEN 'DOJ' THEN 0 ELSE 1 END, source_id) = 1),
x AS (SELECT npi, 'MEDICARE_REVOKED' AS source, DATE '1995-01-01' + CAST(k % 900 AS INTEGER) AS event_dt, CASE WHEN k % 8 = 0 THEN DATE '1999-01-01' + CAST(k % 900 AS INTEGER) END AS window_end, '424.535(A)(' || (k % 23 + 1) || ') GROUND' AS reason, state AS source_state,
    CASE WHEN k % 23 + 1 IN (2, 3, 4, 5, 7, 8, 10, 12, 13, 14, 18, 19, 20, 22, 23) THEN 'A' ELSE 'B' END AS tier, name AS source_name, kind AS source_type FROM c WHERE k % 4 = 0
  UNION SELECT npi, 'OIG_LEIE', DATE '1994-01-01' + CAST(k % 1500 AS INTEGER), CASE WHEN k % 5 = 0 THEN DATE '1999-01-01' + CAST(k % 500 AS INTEGER) END, 'LEIE 1128a' || k % 4 || ' (' || CASE WHEN k % 5 <> 0 THEN kind ELSE '' END || ')', state, 'A', name, kind FROM c WHERE k % 6 = 1 AND k % 12 <> 1
  UNION SELECT npi, 'STATE_EXCL_' || CASE WHEN k % 2 = 0 THEN 'TX' ELSE 'CA' END, DATE '2017-01-01' + CAST(k % 730 AS INTEGER), CASE WHEN k % 3 = 0 THEN DATE '2019-01-01' WHEN k % 4 = 0 THEN DATE '2020-01-01' END, 'State list', CASE WHEN k % 2 = 0 THEN 'TX' ELSE 'CA' END,
    CASE WHEN k % 2 = 0 AND k % 3 <> 0 AND k % 4 <> 0 AND k % 730 < 365 THEN 'B' ELSE 'A' END, name, kind FROM c WHERE k % 7 = 2
  UNION SELECT npi, 'SAM_OPM', DATE '1995-01-01' + CAST(k % 900 AS INTEGER), CASE WHEN k % 2 = 0 THEN DATE '2001-01-01' END, 'Ineligible / ' || CASE WHEN k % 5 <> 0 THEN 'Z1' ELSE '' END, state, 'B', name, kind FROM c WHERE k % 9 = 3 AND k % 3 = 1
  UNION SELECT npi, 'NPPES_DEACTIVATED', deact_dt, react_dt, 'NPI deactivated in NPPES', state, 'B', 'same', kind FROM reg WHERE deact_dt IS NOT NULL AND (react_dt IS NULL OR react_dt <= deact_dt)
  UNION SELECT en.npi, 'TMSIS_DECEASED', min(start_dt), NULL, 'Medicaid enrollment terminated: provider deceased (T-MSIS status 80)' || coalesce('; NPI deactivated in NPPES ' || deact_dt, ''), en.state, CASE WHEN deact_dt IS NOT NULL THEN 'A' ELSE 'B' END, NULL, 'K'
    FROM en JOIN reg ON reg.npi = en.npi AND entity_type = '1' JOIN lt ON lt.npi = en.npi AND lt.state = en.state AND lt.cd = '80' WHERE en.cd = '80' AND start_dt >= DATE '1995-01-01' GROUP BY en.npi, en.state, deact_dt
  UNION SELECT npi, 'TMSIS_TERM_' || cd, min(start_dt), NULL, 'S' || cd, state, 'A', NULL, 'K' FROM en JOIN lt USING (npi, state, cd) WHERE cd IN ('60', '62', '71') GROUP BY npi, state, cd
  UNION SELECT npi, 'SAM_NAME', DATE '1996-01-01' + CAST(k % 500 AS INTEGER), NULL, 'name-matched by model at high confidence: ' || CASE WHEN k % 5 <> 0 THEN 'Ineligible' ELSE '' END, state, 'B', name, 'name_match' FROM c WHERE k % 11 = 4 AND k % 2 = 0 AND k % 3 <> 0
  UNION SELECT npi, CASE WHEN coalesce(category, '') ILIKE '%State Enforcement%' THEN 'STATE_AG' WHEN source = 'DOJ' THEN 'DOJ' ELSE 'OIG' END || CASE tier WHEN 'adjudicated' THEN '_ADJUDICATED' WHEN 'alleged' THEN '_CHARGED' ELSE '_ADMIN' END, event_dt, NULL,
    'enforcement record (' || replace(action_type, '_', ' ') || '): ' || title, state, CASE tier WHEN 'adjudicated' THEN 'A' ELSE 'B' END, name, 'name_match' FROM rel),
y AS (SELECT x.* REPLACE (CASE WHEN source_name = 'same' THEN 'PROVIDER ' || source_type || ' CLINIC' ELSE source_name END AS source_name), reg.npi IS NOT NULL AS known, CASE WHEN reg.npi IS NOT NULL AND source_name IS NOT NULL THEN source_name = 'same' OR (source_name NOT LIKE 'PARTY%' AND source_name <> 'OTHER PERSON') END AS name_agrees FROM x LEFT JOIN reg ON reg.npi = x.npi)
SELECT npi, source, event_dt, window_end, reason, source_state, CASE WHEN NOT name_agrees THEN 'C' ELSE tier END AS tier, source_name, source_type, name_agrees,
  CASE WHEN source_type = 'name_match' THEN 'name_match_model_high' WHEN NOT known THEN 'exact_npi_not_in_nppes' WHEN source_name IS NULL THEN 'exact_npi_unnamed_source' WHEN name_agrees THEN 'exact_npi_name_verified' ELSE 'exact_npi_name_conflict' END AS id_match FROM y"""

def summaries(spark, sf_dir):
    """The detector's summaries as rows (summary, key, n, paid_c): the headline over providers, by year of the first event, by
    list, by identity match and tier, and by how many months were paid."""
    months, ev = materialize(bill_month(spark, sf_dir), "bill-months"), materialize(_events(spark, sf_dir), "list-events")
    pa = materialize(d3.paid_after(months, ev).join(ev.select("npi", "source", "event_dt", "id_match").distinct(), ["npi", "source", "event_dt"]), "paid-after")
    who = materialize(d3.provider_paid(d3.provider_rollup(ev.where("tier = 'A'")), months), "providers-paid")
    paid = who.where("after_c > 0")
    rows = lambda df, name, key: df.groupBy(key.cast("string").alias("key")).agg(F.countDistinct("npi").alias("n"), F.sum("after_c").alias("paid_c")).select(F.lit(name).alias("summary"), "key", "n", "paid_c")
    parts = [
        rows(who, "headline", F.lit("listed")), rows(paid, "headline", F.lit("paid after")), rows(paid.where("months_after >= 6"), "headline", F.lit("paid in six months or more")), rows(paid, "by year", F.year("first_event_dt")),
        rows(paid, "by lists", F.col("sources")), rows(pa, "by list and tier", F.concat_ws(" ", "source", "tier")), rows(pa, "by match and tier", F.concat_ws(" ", "id_match", "tier")), rows(pa.where("tier = 'C'"), "set aside", F.lit("C")),
        rows(pa, "by months", F.when(F.col("months_after") >= 6, "6+").otherwise("1-5")),
    ]
    from functools import reduce

    return reduce(lambda a, b: a.unionByName(b), parts)


def _summaries_sql() -> str:
    parts = (
        ("who", "headline", "'listed'", "TRUE"), ("who", "headline", "'paid after'", "after_c > 0"), ("who", "headline", "'paid in six months or more'", "after_c > 0 AND months_after >= 6"), ("who", "by year", "CAST(year(first_event_dt) AS VARCHAR)", "after_c > 0"),
        ("who", "by lists", "sources", "after_c > 0"), ("px", "by list and tier", "source || ' ' || tier", "TRUE"), ("px", "by match and tier", "id_match || ' ' || tier", "TRUE"), ("px", "set aside", "'C'", "tier = 'C'"), ("px", "by months", "CASE WHEN months_after >= 6 THEN '6+' ELSE '1-5' END", "TRUE"),
    )
    rows = " UNION ALL ".join(f"SELECT '{n}' AS summary, {k} AS key, count(DISTINCT npi) AS n, CAST(sum(after_c) AS BIGINT) AS paid_c FROM {t} WHERE {w} GROUP BY 2" for t, n, k, w in parts)
    return f"""WITH {AFTER_CTE}, px AS (SELECT pa.*, id_match FROM pa JOIN (SELECT DISTINCT npi, source, event_dt, id_match FROM ev) USING (npi, source, event_dt)),
ro AS (SELECT npi, min(event_dt) AS first_event_dt, string_agg(DISTINCT source, ',' ORDER BY source) AS sources, CASE WHEN NOT bool_or(window_end IS NULL) THEN max(window_end) END AS window_end FROM ev WHERE tier = 'A' GROUP BY 1),
who AS (SELECT ro.npi, any_value(first_event_dt) AS first_event_dt, any_value(sources) AS sources, count(m.month_start) AS months_after, CAST(coalesce(sum(paid_c), 0) AS BIGINT) AS after_c FROM ro LEFT JOIN bill_month m ON m.npi = ro.npi AND m.month_start >= date_trunc('month', first_event_dt) + INTERVAL 1 MONTH AND (window_end IS NULL OR m.month_start < date_trunc('month', window_end)) GROUP BY 1)
{rows}"""


QUERIES = {
    "listed_summaries": (summaries, _summaries_sql()),
    "listed_nine_sources": (nine_sources, NINE),
    "listed_events": (list_events, LIST_EVENTS),
    "listed_paid_after": (after, f"WITH {AFTER_CTE} SELECT * FROM pa"),
    "listed_enrolled_after": (enrolled, ENROLLED),
    "listed_cross_state": (cross, CROSS),
    "listed_providers": (providers, PROVIDERS),
    "listed_flags": (flags, FLAGS),
    "listed_summary": (summary, SUMMARY),
}
