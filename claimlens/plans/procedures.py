"""Procedure norms and the procedure signal; then the fusion of detectors into one tiered, ranked table."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimlens.operators import fusion as fu
from claimlens.operators import procedures as pr
from claimlens.operators.ranking import global_rank
from claimlens.plans.data import BILL_MONTH, MATCHES, SPEND, STATES, actions, bill_month, lines, matches, r4, spend, states
from claimlens.plans.listed import AFTER_CTE, _after
from claimlens.plans.network import MEMBERS, _members
from claimlens.plans.volume import MONTHS_CTE, _months, _spend
from claimlens.session import materialize, sweep

#: The tables' codes are few and alike, so the query's thresholds are lower than the operator's own.
LOW = {"pct": 0.9, "months": 3, "patients": 10, "share": 0.2, "ratio": 1.01, "services": 50}
#: Renderers of a billing organisation that make an umbrella of it, in the tables.
RENDERERS = 45.0
LAST_YEAR = 1998


def _codes(df):
    return materialize(pr.code_table(df.withColumn("high_vector", F.col("minutes") > 35)), "codes")


CODES = f"""{SPEND}, c0 AS (SELECT npi, hcpcs, CAST(sum(paid_c) AS BIGINT) AS paid_c, CAST(sum(patients) AS BIGINT) AS patient_months, count(DISTINCT month_start) AS months, bool_or(minutes > 35) AS high_vector, CAST(sum(charge_c) AS BIGINT) AS charge_c, CAST(sum(allowed_c) AS BIGINT) AS allowed_c, CAST(sum(lines) AS BIGINT) AS services FROM spend GROUP BY 1, 2),
codes AS (SELECT c0.*, CAST(paid_c AS DOUBLE) / nullif(patient_months, 0) AS dpm, percent_rank() OVER (PARTITION BY hcpcs ORDER BY CAST(paid_c AS DOUBLE) / nullif(patient_months, 0) ASC NULLS LAST) AS pct,
  CAST(paid_c AS DOUBLE) / (sum(paid_c) OVER (PARTITION BY npi)) AS share, CAST(charge_c AS DOUBLE) / nullif(allowed_c, 0) AS charge_ratio FROM c0)"""


def norms(spark, sf_dir):
    """Quantiles of dollars a patient month by code, and the median charge ratio, with minimum support."""
    g = pr.code_norms(_codes(lines(spark, sf_dir)))
    return g.select("hcpcs", "n", *(r4(F.col(c)).alias(c) for c in ("p50", "p90", "p95", "peer_ratio")))


NORMS = f"WITH {CODES} SELECT hcpcs, count(*) AS n, round(quantile_cont(dpm, 0.5), 4) AS p50, round(quantile_cont(dpm, 0.9), 4) AS p90, round(quantile_cont(dpm, 0.95), 4) AS p95, round(median(charge_ratio), 4) AS peer_ratio FROM codes GROUP BY 1 HAVING count(*) >= 20"


def _signal(df):
    codes = _codes(df)
    return pr.signal(codes, pr.code_norms(codes), **LOW)


SIGNAL_CTE = f"""{CODES}, peer AS (SELECT hcpcs, median(charge_ratio) AS peer FROM codes GROUP BY 1 HAVING count(*) >= 20), t5 AS (SELECT * FROM codes QUALIFY row_number() OVER (PARTITION BY npi ORDER BY paid_c DESC, hcpcs) <= 5),
t6 AS (SELECT *, coalesce(pct >= 0.9::DOUBLE AND months >= 3 AND patient_months >= 10, FALSE) AS hot, coalesce(charge_ratio >= 1.01::DOUBLE * peer AND services >= 50, FALSE) AS dear FROM t5 LEFT JOIN peer USING (hcpcs)),
per AS (SELECT npi, max(CAST(hot AS INTEGER)) AS intense, sum(CASE WHEN high_vector THEN share ELSE 0 END) AS high_share, max(CAST(dear AS INTEGER)) AS over, arg_max(hcpcs, (pct, hcpcs)) FILTER (WHERE hot) AS intense_code, arg_max(hcpcs, (charge_ratio, hcpcs)) FILTER (WHERE dear) AS dear_code FROM t6 GROUP BY 1),
sig AS (SELECT npi, CAST(4 * intense + CASE WHEN high_share >= 0.2::DOUBLE THEN 2 ELSE 0 END + 2 * over AS INTEGER) AS points, intense_code, round(high_share, 4) AS high_share,
  concat_ws('; ', CASE WHEN intense = 1 THEN 'dollars per patient on code ' || intense_code || ' among the highest' END, CASE WHEN high_share >= 0.2::DOUBLE THEN 'most dollars on codes open to abuse' END, CASE WHEN over = 1 THEN 'charges on code ' || dear_code || ' far above the usual' END) AS reason FROM per WHERE 4 * intense + CASE WHEN high_share >= 0.2::DOUBLE THEN 2 ELSE 0 END + 2 * over > 0)"""


def signal(spark, sf_dir):
    return _signal(lines(spark, sf_dir)).withColumn("high_share", r4(F.col("high_share")))


def trends(spark, sf_dir):
    """How much likelier providers with returned shipments of tier A bill each code."""
    from claimlens.plans.data import events

    x = pr.lift(lines(spark, sf_dir).select("npi", "hcpcs"), events(spark, sf_dir).where("tier = 'A'"))
    return x.withColumn("lift", r4(F.col("lift")))


TRENDS = """WITH f AS (SELECT DISTINCT l_suppkey AS npi FROM lineitem WHERE l_returnflag = 'R' AND l_suppkey % 3 = 0), x AS (SELECT DISTINCT l_suppkey AS npi, p_brand AS hcpcs FROM lineitem JOIN part ON l_partkey = p_partkey),
t AS (SELECT count(DISTINCT npi) AS n, count(DISTINCT npi) FILTER (WHERE npi IN (SELECT npi FROM f)) AS nf FROM x)
SELECT hcpcs, count(*) AS n_all, count(*) FILTER (WHERE npi IN (SELECT npi FROM f)) AS n_flagged, round((CAST(count(*) FILTER (WHERE npi IN (SELECT npi FROM f)) AS DOUBLE) / max(nf)) / (count(*) / max(n)), 4) AS lift FROM x, t GROUP BY 1"""


def umbrella(spark, sf_dir):
    pairs = spend(spark, sf_dir).select("npi", F.col("servicing").alias("billing"))
    return fu.umbrella_size(pairs).withColumn("avg_org_render", r4(F.col("avg_org_render")))


UMBRELLA_CTE = "pr AS (SELECT DISTINCT npi, servicing AS billing FROM spend), sz AS (SELECT billing, count(*) AS n FROM pr GROUP BY 1), um AS (SELECT npi, avg(n) AS avg_org_render, max(n) AS max_org_render FROM pr JOIN sz USING (billing) GROUP BY 1)"


def _fused(spark, sf_dir):
    sp = _spend(spark, sf_dir, "charge_c", "allowed_c")
    d3 = _after(spark, sf_dir).where("tier in ('A', 'B')").groupBy("npi").agg(
        F.max((F.col("tier") == "A").cast("int")).alias("d3_a"), F.max("after_c").alias("d3_c"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("d3_sources"), F.min("event_dt").alias("d3_first"), F.max("months_after").alias("d3_months"),
    )
    m = _months(spark, sf_dir, sp)
    hit = lambda *names: F.count_if(F.col("label").isin(*names))
    d2 = m.groupBy("npi", "entity_type").agg(
        F.count_if(F.col("label").startswith("IMPOSSIBLE")).alias("impossible"), hit("EXCEEDS_DAILY_CAP").alias("over_cap"), hit("UMBRELLA_VOLUME").alias("umbrella_months"), hit("IMPLAUSIBLE_OVER_16H").alias("implausible"),
        F.max("n_billing").alias("orgs"), F.max("patients").alias("max_patients"), F.sum(F.when(F.col("label").isNotNull(), F.col("paid_c")).otherwise(0)).alias("d2_c"),
    )
    d2 = fu.volume_findings(d2, fu.umbrella_size(sp.select("npi", F.col("servicing").alias("billing"))), renderers=RENDERERS).drop("entity_type")
    d2 = materialize(d2, "volume-findings")
    sweep(spark)
    member = _members(spark, sf_dir)[1].where("node like 'provider:%'").select(F.split("node", ":")[1].cast("long").alias("npi"), F.col("component").alias("cluster"))
    year = sp.where(F.col("year") == LAST_YEAR).groupBy("npi").agg(F.sum("paid_c").alias("d1_c"))
    member = materialize(member.join(states(spark, sf_dir).select("npi", (F.col("balance") < 0).alias("bad")), "npi").join(year, "npi", "left"), "network-members")
    rank = global_rank(member.groupBy("cluster").agg(F.count("*").alias("n"), F.max(F.col("bad").cast("int")).alias("d1_label")), [F.col("n").desc(), F.col("cluster")], "d1_rank")
    d1 = member.select("npi", "cluster", "d1_c").join(rank.select("cluster", "d1_label", "d1_rank", (F.col("n") >= 3).alias("d1_eligible")), "cluster")
    months = materialize(bill_month(spark, sf_dir), "paid-months")
    enf = fu.enforcement_findings(matches(spark, sf_dir).withColumn("npi", F.col("npi") % 100 + 1), actions(spark, sf_dir), months)
    points = _signal(sp).select("npi", "points", F.col("reason").alias("procedure_reason"))
    sweep(spark)
    return fu.fuse(d3, d2, d1, points, enf, fu.exposure(months))


FUSED_CTE = f"""{MEMBERS.replace('WITH RECURSIVE ', '')}, {MONTHS_CTE}, {AFTER_CTE.replace(STATES + ', ', '')}, {SIGNAL_CTE.replace(SPEND + ', ', '')}, {MATCHES}, {UMBRELLA_CTE},
d3 AS (SELECT npi, max(CASE WHEN tier = 'A' THEN 1 ELSE 0 END) AS d3_a, max(after_c) AS d3_c, string_agg(DISTINCT source, ',' ORDER BY source) AS d3_sources, min(event_dt) AS d3_first, max(months_after) AS d3_months FROM pa WHERE tier IN ('A', 'B') GROUP BY 1),
d2x AS (SELECT npi, entity_type, count(*) FILTER (WHERE label LIKE 'IMPOSSIBLE%') AS impossible, count(*) FILTER (WHERE label = 'EXCEEDS_DAILY_CAP') AS over_cap, count(*) FILTER (WHERE label = 'UMBRELLA_VOLUME') AS umbrella_months, count(*) FILTER (WHERE label = 'IMPLAUSIBLE_OVER_16H') AS implausible,
  max(n_billing) AS orgs, max(patients) AS max_patients, CAST(sum(CASE WHEN label IS NOT NULL THEN paid_c ELSE 0 END) AS BIGINT) AS d2_c FROM lab GROUP BY 1, 2),
d2y AS (SELECT d2x.*, max_patients > 500 OR coalesce(avg_org_render, 0) >= 45 AS umbrella FROM d2x LEFT JOIN um USING (npi)),
d2 AS (SELECT *, CASE WHEN over_cap > 0 OR (impossible > 0 AND entity_type = '2') OR (impossible > 0 AND orgs >= 3 AND NOT umbrella) THEN 'A' WHEN impossible > 0 THEN 'B' ELSE 'C' END AS d2_tier FROM d2y WHERE impossible > 0 OR over_cap > 0 OR umbrella_months > 0 OR implausible > 0),
mem AS (SELECT CAST(split_part(node, ':', 2) AS BIGINT) AS npi, component AS cluster FROM c JOIN big USING (component) WHERE node LIKE 'provider:%'), yr AS (SELECT npi, CAST(sum(paid_c) AS BIGINT) AS d1_c FROM spend WHERE year = {LAST_YEAR} GROUP BY 1),
rk AS (SELECT cluster, count(*) AS n, max(CAST(balance < 0 AS INTEGER)) AS d1_label, row_number() OVER (ORDER BY count(*) DESC, cluster) AS d1_rank FROM mem JOIN states USING (npi) GROUP BY 1),
d1 AS (SELECT mem.npi, cluster, d1_c, d1_label, d1_rank, n >= 3 AS d1_eligible FROM mem JOIN rk USING (cluster) LEFT JOIN yr USING (npi)),
em AS (SELECT m.* REPLACE (npi % 100 + 1 AS npi), category FROM matches m JOIN actions USING (source_id) WHERE same_entity AND confidence = 'high' AND coalesce(is_subject, TRUE) AND event_dt IS NOT NULL AND tier IN ('adjudicated', 'alleged')),
enf AS (SELECT npi, max(CAST(tier = 'adjudicated' AS INTEGER)) AS enf_adjudicated, max(CAST(tier = 'alleged' AS INTEGER)) AS enf_alleged, min(event_dt) AS enf_first, string_agg(DISTINCT replace(action_type, '_', ' '), ', ' ORDER BY replace(action_type, '_', ' ')) AS enf_actions,
  list_sort(list(DISTINCT CASE WHEN coalesce(category, '') ILIKE '%State Enforcement%' THEN 'STATE_AG' WHEN source = 'DOJ' THEN 'DOJ' ELSE 'OIG' END)) AS enf_sources, arg_max(url, (event_dt, url)) AS enf_url FROM em WHERE npi IN (SELECT npi FROM bill_month) GROUP BY 1),
ex AS (SELECT npi, CAST(sum(paid_c) AS BIGINT) AS exposure_c FROM bill_month WHERE month_start >= (SELECT max(month_start) - INTERVAL 11 MONTH FROM bill_month) GROUP BY 1),
keys AS (SELECT npi FROM d3 UNION SELECT npi FROM d2 UNION SELECT npi FROM d1 WHERE d1_eligible UNION SELECT npi FROM enf),
f AS (SELECT keys.npi, CAST(CASE WHEN d3_a = 1 OR enf_adjudicated = 1 THEN 1 WHEN d2_tier = 'A' THEN 2 WHEN (d1_eligible AND d1_label = 1) OR enf_alleged = 1 THEN 3 WHEN d1_eligible OR d2_tier = 'B' THEN 4 ELSE 5 END AS INTEGER) AS tier,
  CASE WHEN d3_a = 1 THEN 'documented action, then payment' WHEN enf_adjudicated = 1 THEN 'adjudicated in a public enforcement record' WHEN d2_tier = 'A' THEN 'impossible volume with concurrency' WHEN d1_eligible AND d1_label = 1 THEN 'network structure with a list link'
    WHEN enf_alleged = 1 THEN 'charged in a public enforcement record' WHEN d1_eligible OR d2_tier = 'B' THEN 'structure or single-organization volume' ELSE 'informational' END AS tier_label,
  CAST(coalesce(CASE WHEN d3_a = 1 THEN 1 END, 0) + CASE WHEN d2_tier IN ('A', 'B') THEN 1 ELSE 0 END + CASE WHEN d1_eligible THEN 1 ELSE 0 END + CASE WHEN enf.npi IS NOT NULL AND d3.npi IS NULL THEN 1 ELSE 0 END AS INTEGER) AS n_detectors,
  CAST(coalesce(CASE WHEN d3_a = 1 THEN 1 END, 0) + CASE WHEN d2_tier = 'A' THEN 1 ELSE 0 END + CASE WHEN d1_eligible THEN 1 ELSE 0 END + CASE WHEN enf_adjudicated = 1 AND coalesce(d3_a, 0) = 0 THEN 1 ELSE 0 END AS INTEGER) AS n_strong,
  CAST(CASE WHEN d3_a = 1 THEN coalesce(d3_c, 0) WHEN enf_adjudicated = 1 THEN coalesce(exposure_c, 0) WHEN d2_tier = 'A' THEN coalesce(d2_c, 0) WHEN d1_eligible AND d1_label = 1 THEN coalesce(d1_c, 0) WHEN enf_alleged = 1 THEN coalesce(exposure_c, 0)
    WHEN d1_eligible OR d2_tier = 'B' THEN greatest(CASE WHEN d1_eligible THEN coalesce(d1_c, 0) ELSE 0 END, CASE WHEN d2_tier = 'B' THEN coalesce(d2_c, 0) ELSE 0 END) ELSE greatest(coalesce(d3_c, 0), coalesce(d2_c, 0)) END AS BIGINT) AS dollars_c,
  array_to_string(list_filter([CASE WHEN d3.npi IS NOT NULL THEN 'D3' END, CASE WHEN d2.npi IS NOT NULL THEN 'D2' END, CASE WHEN d1.npi IS NOT NULL THEN 'D1' END, CASE WHEN enf.npi IS NOT NULL THEN 'ENF' END], lambda x: x IS NOT NULL), ',') AS detectors,
  coalesce(points, 0) AS points, d3_a, d3_sources, d3_first, d3_months, d3_c, d2_tier, impossible, orgs, over_cap, d2.umbrella, max_patients, d1_eligible, cluster, d1_rank, sig.reason AS procedure_reason, coalesce(exposure_c, 0) AS exposure_c, enf_adjudicated, enf_alleged, enf_first, enf_actions, enf_sources, enf_url
  FROM keys LEFT JOIN d3 USING (npi) LEFT JOIN d2 USING (npi) LEFT JOIN d1 USING (npi) LEFT JOIN sig USING (npi) LEFT JOIN enf USING (npi) LEFT JOIN ex USING (npi)),
g AS (SELECT *, least(100.0::DOUBLE, CASE tier WHEN 1 THEN 90 WHEN 2 THEN 75 WHEN 3 THEN 60 WHEN 4 THEN 45 ELSE 25 END + least(16, 8 * greatest(n_strong - 1, 0)) + least(9.0::DOUBLE, log10(greatest(dollars_c / 100, 1))) + points) AS score FROM f)"""


def fused(spark, sf_dir):
    x = fu.ranked(_fused(spark, sf_dir))
    return x.select("npi", "tier", "tier_label", "n_detectors", "n_strong", "dollars_c", F.array_join("detectors", ",").alias("detectors"), r4(F.col("score")).alias("score"), "enf_url", "d1_rank", fu.reason().alias("reasons"), "rank")


_COUNT = lambda c, w: f"{c} || CASE WHEN {c} = 1 THEN ' {w}' ELSE ' {w}s' END"
_MONEY = lambda c: f"'$' || format('{{:,}}', {c} // 100)"
_PRETTY = "array_to_string(list_transform({}, lambda s: CASE s WHEN 'STATE_AG' THEN 'a state attorney general release' WHEN 'DOJ' THEN 'a Department of Justice release' WHEN 'OIG' THEN 'an HHS-OIG enforcement record' ELSE lower(s) END), ' and ')"
FUSED = f"""WITH RECURSIVE {FUSED_CTE} SELECT npi, tier, tier_label, n_detectors, n_strong, dollars_c, detectors, round(score, 4) AS score, enf_url, d1_rank,
  concat_ws('; ', CASE WHEN d3_a = 1 THEN 'Listed on ' || {_PRETTY.format("string_split(d3_sources, ',')")} || ' since ' || strftime(d3_first, '%B %-d, %Y') || ', then paid in ' || {_COUNT('d3_months', 'later month')} || ', ' || {_MONEY('d3_c')} || ' in total' END,
    CASE WHEN enf_adjudicated = 1 THEN 'Adjudicated (' || enf_actions || ') according to ' || {_PRETTY.format('enf_sources')} || ' of ' || strftime(enf_first, '%B %-d, %Y') || CASE WHEN coalesce(d3_a, 0) = 1 THEN '' WHEN exposure_c > 0 THEN ', paid ' || {_MONEY('exposure_c')} || ' in the last twelve months on file' ELSE ', not paid in the last twelve months on file' END
      WHEN enf_alleged = 1 THEN 'Charged (' || enf_actions || ') according to ' || {_PRETTY.format('enf_sources')} || ' of ' || strftime(enf_first, '%B %-d, %Y') || ', not adjudicated' || CASE WHEN exposure_c > 0 THEN ', paid ' || {_MONEY('exposure_c')} || ' in the last twelve months on file' ELSE '' END END,
    CASE WHEN d2_tier = 'A' THEN CASE WHEN impossible > 0 THEN 'More hours than a day holds in ' || {_COUNT('impossible', 'month')} || ', billed by ' || {_COUNT('orgs', 'organization')} END
      WHEN d2_tier = 'B' AND umbrella THEN 'More hours than a day holds in ' || {_COUNT('impossible', 'month')} || ', with up to ' || max_patients || ' patients a month: likely a supervisor''s number, records needed'
      WHEN d2_tier = 'B' THEN 'More hours than a day holds in ' || {_COUNT('impossible', 'month')} || ' under few organizations: possibly supervised staff, records needed' END,
    CASE WHEN over_cap > 0 THEN 'Over the daily cap in ' || {_COUNT('over_cap', 'month')} END, CASE WHEN d1_eligible THEN 'Member of provider network ' || cluster || ', rank ' || d1_rank END, procedure_reason,
    CASE WHEN n_strong >= 2 THEN 'Confirmed by ' || n_strong || ' detectors' WHEN n_detectors >= 2 THEN 'Another detector points the same way, less strongly' END) AS reasons,
  row_number() OVER (ORDER BY score DESC, dollars_c DESC, npi) AS rank FROM g"""

QUERIES = {
    "procedure_norms": (norms, NORMS),
    "procedure_signal": (signal, f"WITH {SIGNAL_CTE} SELECT npi, points, intense_code, high_share, reason FROM sig"),
    "procedure_lift": (trends, TRENDS),
    "volume_umbrella": (umbrella, f"WITH {SPEND}, {UMBRELLA_CTE} SELECT npi, round(avg_org_render, 4) AS avg_org_render, max_org_render FROM um"),
    "risk_fusion": (fused, FUSED),
}
