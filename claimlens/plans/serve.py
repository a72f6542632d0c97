"""Serving queries over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimlens.operators import serve as sv
from claimlens.plans.data import BILL_MONTH, EVENTS, STATES, bill_month, cents, events, r4, states, table


def verify(spark, sf_dir):
    """Orders as claims of their suppliers, against list events."""
    li = table(spark, sf_dir, "lineitem")
    claims = li.groupBy("l_orderkey").agg(F.min(F.to_date("l_shipdate")).alias("start"), F.collect_set("l_suppkey").alias("npis"), F.sum(cents("l_extendedprice")).alias("paid"))
    claims = claims.select(F.col("l_orderkey").alias("id"), "start", F.lit(None).cast("date").alias("end"), "npis", "paid")
    ev = events(spark, sf_dir).withColumn("source", F.lit("RETURNS"))
    return sv.verify_claims(claims, ev).select("id", "paid", "flagged", F.coalesce(F.size("hits"), F.lit(0)).cast("long").alias("n_hits"))


VERIFY = f"""WITH {EVENTS}, c AS (SELECT l_orderkey AS id, CAST(min(l_shipdate) AS DATE) AS start, list(DISTINCT l_suppkey) AS npis, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS paid FROM lineitem GROUP BY 1),
u AS (SELECT id, start, unnest(npis) AS npi FROM c), h AS (SELECT id, count(*) AS n FROM u JOIN events_list USING (npi) WHERE start > event_dt AND (window_end IS NULL OR start <= window_end) GROUP BY 1)
SELECT id, paid, coalesce(n, 0) > 0 AS flagged, coalesce(n, 0) AS n_hits FROM c LEFT JOIN h USING (id)"""


def prefix(spark, sf_dir):
    reg = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("npi"), F.col("c_name").alias("name"))
    return sv.search(reg, "112", 40).select("npi", "name")


PREFIX = "SELECT c_custkey AS npi, c_name AS name FROM customer WHERE CAST(c_custkey AS VARCHAR) LIKE '112%' ORDER BY c_custkey LIMIT 40"


def evidence(spark, sf_dir):
    """Flat, numbered statements about a provider from three sources."""
    e, m, s = events(spark, sf_dir), bill_month(spark, sf_dir), states(spark, sf_dir)
    paid = m.groupBy("npi").agg(F.count("*").alias("n"))
    return sv.evidence_lines([
        (e, "list", F.concat(F.lit("Listed on "), F.date_format("event_dt", "yyyy-MM-dd"))),
        (paid, "payments", F.concat(F.lit("Paid in "), F.col("n").cast("string"), F.lit(" months"))),
        (s.where("balance < 0"), "registry", F.concat(F.lit("Owes in "), "nation")),
    ])


EVIDENCE = f"""WITH {EVENTS}, {BILL_MONTH}, {STATES}, u AS (SELECT npi AS subject, 'list' AS source, 'Listed on ' || strftime(event_dt, '%Y-%m-%d') AS statement FROM events_list UNION ALL SELECT npi, 'payments', 'Paid in ' || count(*) || ' months' FROM bill_month GROUP BY 1
  UNION ALL SELECT npi, 'registry', 'Owes in ' || nation FROM states WHERE balance < 0)
SELECT subject, source, statement, CAST(row_number() OVER (PARTITION BY subject ORDER BY source, statement) AS INTEGER) AS line FROM u"""


def public_score(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("npi"), cents("s_acctbal").alias("v"))
    return sv.scaled(s, "v", "score").select("npi", r4(F.col("score")).alias("score"))


PUBLIC = "WITH s AS (SELECT s_suppkey AS npi, CAST(round(s_acctbal * 100) AS BIGINT) AS v FROM supplier) SELECT npi, round(100 * CAST(v - (SELECT min(v) FROM s) AS DOUBLE) / ((SELECT max(v) FROM s) - (SELECT min(v) FROM s)), 4) AS score FROM s"


KINDS = tuple(sv.GROUNDS)


def _kinds():
    """Up to three kinds of evidence of a supplier, all kinds among all suppliers, some unknown."""
    k = F.col("s_suppkey")
    table_ = F.array(*map(F.lit, KINDS))
    pick = lambda c: F.element_at(table_, (c % len(KINDS) + 1).cast("int"))
    return F.filter(F.array(F.when(k % 2 == 0, pick(k / 2)), F.when(k % 3 != 0, pick(k * 7)), F.when(k % 5 == 0, F.lit("unknown"))), lambda x: x.isNotNull())


KINDS_SQL = f"""kd AS (SELECT s_suppkey AS npi, list_filter([CASE WHEN s_suppkey % 2 = 0 THEN kk[s_suppkey // 2 % 16 + 1] END, CASE WHEN s_suppkey % 3 <> 0 THEN kk[s_suppkey * 7 % 16 + 1] END, CASE WHEN s_suppkey % 5 = 0 THEN 'unknown' END], lambda x: x IS NOT NULL) AS kinds
  FROM supplier, (SELECT [{', '.join(f"'{k}'" for k in KINDS)}] AS kk)), gt(kind, i, g) AS (VALUES {', '.join(f"('{k}', {i}, '{g}')" for k, v in sv.GROUNDS.items() for i, g in enumerate(v))}),
gx AS (SELECT npi, k, p, i, g FROM (SELECT npi, unnest(kinds) AS k, unnest(range(len(kinds))) AS p FROM kd) JOIN gt ON kind = k), gu AS (SELECT npi, g, min(p * 100 + i) AS o FROM gx GROUP BY 1, 2), gl AS (SELECT npi, string_agg(g, '|' ORDER BY o) AS grounds FROM gu GROUP BY 1)"""


def grounds(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("npi"), F.array_join(sv.grounds(_kinds()), "|").alias("grounds"))


GROUNDS = f"WITH {KINDS_SQL} SELECT npi, coalesce(grounds, '455.410') AS grounds FROM kd LEFT JOIN gl USING (npi)"


def flag_kinds(spark, sf_dir):
    """The kind of evidence of detectors' flags and of networks' features."""
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    pick = lambda *v: F.element_at(F.array(*map(F.lit, v)), (k % len(v) + 1).cast("int"))
    source, label = pick("MEDICARE_REVOKED", "OIG_LEIE", "STATE_EXCL_TX", "SAM_OPM", "NPPES_DEACTIVATED", "DOJ"), pick("IMPOSSIBLE_PER_PATIENT", "EXCEEDS_DAILY_CAP", "IMPOSSIBLE_BY_LINE_COUNT", "UMBRELLA_VOLUME", "ELEVATED_OVER_12H")
    nets = sv.network_kinds(k % 2, k % 3, k % 4, F.when(k % 5 > 0, k % 6), k % 7, F.array(pick("OIG_LEIE", "OTHER", "SAM")), k % 11 - 9, k % 13 - 11)
    return s.select(k.alias("npi"), sv.flag_kind(F.lit("D3"), source, label).alias("listed"), sv.flag_kind(F.lit("D2"), source, label).alias("volume"), F.array_join(nets, ",").alias("network"))


FLAG_KINDS = """SELECT s_suppkey AS npi, ['MEDICARE_REVOKED_PAID_AFTER', 'OIG_LEIE_PAID_AFTER', 'STATE_EXCL_PAID_AFTER', 'SAM_PAID_AFTER', 'NPPES_DEACTIVATED_PAID_AFTER', NULL][s_suppkey % 6 + 1] AS listed, ['PER_PATIENT_IMPOSSIBLE', 'MN_DAILY_CAP', 'IMPOSSIBLE_HOURS', 'UMBRELLA_VOLUME', NULL][s_suppkey % 5 + 1] AS volume,
  array_to_string(list_filter([CASE WHEN s_suppkey % 2 >= 1 THEN 'NETWORK_SHARED_OWNERS' END, CASE WHEN greatest(s_suppkey % 3, s_suppkey % 4, CASE WHEN s_suppkey % 5 > 0 THEN s_suppkey % 6 ELSE 0 END) >= 2 THEN 'NETWORK_SHARED_ADDRESS' END, CASE WHEN s_suppkey % 7 >= 3 THEN 'NETWORK_INCORPORATION_BURST' END,
    CASE WHEN s_suppkey % 3 <> 1 THEN 'NETWORK_OWNER_ON_LEIE' END, CASE WHEN s_suppkey % 11 > 9 THEN 'NETWORK_ADDRESS_OF_REVOKED_ENTITY' END, CASE WHEN s_suppkey % 13 > 11 THEN 'NETWORK_MEMBER_ON_LIST' END], lambda x: x IS NOT NULL), ',') AS network FROM supplier"""


def packets(spark, sf_dir):
    """A packet for each provider: findings that cite lines, grounds and caveats."""
    kinds = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("subject"), _kinds().alias("kinds"))
    x = sv.packet(evidence(spark, sf_dir), kinds)
    cited = F.array_join(F.transform("findings", lambda f: F.concat_ws(":", F.array_join(f["evidence_ids"], "+"), f["text"])), "; ")
    return x.select("subject", "summary", cited.alias("findings"), F.size("evidence").alias("n_lines"), F.array_join("evidence_kinds", ",").alias("kinds"), F.array_join("grounds", "|").alias("grounds"), F.size("caveats").alias("n_caveats"))


PACKETS = f"""WITH {KINDS_SQL}, ln AS ({EVIDENCE}), lg AS (SELECT subject, arg_min(statement, line) AS summary, coalesce(string_agg((line - 1) || ':' || statement, '; ' ORDER BY line) FILTER (WHERE line BETWEEN 2 AND 31), '') AS findings, CAST(count(*) AS INTEGER) AS n_lines FROM ln GROUP BY 1)
SELECT subject, summary, findings, n_lines, array_to_string(kinds, ',') AS kinds, coalesce(grounds, '455.410') AS grounds, CAST(1 + len(list_filter(kinds, lambda k: k IN ({', '.join(f"'{c}'" for c in sv.CAVEATS)}))) AS INTEGER) AS n_caveats FROM lg JOIN kd ON npi = subject LEFT JOIN gl USING (npi)"""


def _risk(spark, sf_dir):
    """A ranked table of suppliers with place, detectors and dollars."""
    s = states(spark, sf_dir)
    k = F.col("npi")
    det = F.filter(F.array(F.when(k % 2 == 0, "D3"), F.when(k % 3 == 0, "D2"), F.when(k % 5 == 0, "D1")), lambda x: x.isNotNull())
    return s.where("npi % 7 <> 0").select("npi", "state", "nation", F.col("nation").alias("place"), (k % 5 + 1).alias("tier"), cents("balance").alias("dollars_c"), det.alias("detectors"), (k % 4).alias("n_strong"), (k * 37 % 1009).alias("rank"))


RISK = f"""{STATES}, risk AS (SELECT npi, state, nation, npi % 5 + 1 AS tier, CAST(round(balance * 100) AS BIGINT) AS dollars_c, list_filter([CASE WHEN npi % 2 = 0 THEN 'D3' END, CASE WHEN npi % 3 = 0 THEN 'D2' END, CASE WHEN npi % 5 = 0 THEN 'D1' END], lambda x: x IS NOT NULL) AS detectors, npi % 4 AS n_strong, npi * 37 % 1009 AS rank FROM states WHERE npi % 7 <> 0)"""


def tiers(spark, sf_dir):
    return sv.tier_counts(_risk(spark, sf_dir))


TIERS = f"WITH {RISK} SELECT tier, count(*) AS n, CAST(sum(dollars_c) AS BIGINT) AS dollars_c, count(*) FILTER (WHERE n_strong >= 2) AS corroborated FROM risk GROUP BY 1"


def place_top(spark, sf_dir):
    """The eight best ranked of one region: a page."""
    return sv.top_of_place(_risk(spark, sf_dir), "state", "ASIA").select("npi", "tier", "dollars_c", "rank")


PLACE_TOP = f"WITH {RISK} SELECT npi, tier, dollars_c, rank FROM risk WHERE state = 'ASIA' ORDER BY rank LIMIT 8"


def area(spark, sf_dir):
    """What is around each provider: in its nation if enough is there, else in its region."""
    who = states(spark, sf_dir).select("npi", "nation", "state")
    return sv.area_context(_risk(spark, sf_dir), who, ["nation", "state"], 4)


AREA = f"""WITH {RISK}, nn AS (SELECT nation, count(*) AS n FROM risk GROUP BY 1), w AS (SELECT npi, nation, state, CASE WHEN coalesce(n, 0) >= 4 THEN 'nation' ELSE 'state' END AS scope FROM states LEFT JOIN nn USING (nation)),
a AS (SELECT w.npi, scope, CASE scope WHEN 'nation' THEN w.nation ELSE w.state END AS area FROM w), r AS (SELECT a.npi, a.scope, a.area, x.npi AS other, x.dollars_c, x.detectors FROM a LEFT JOIN risk x ON CASE a.scope WHEN 'nation' THEN x.nation ELSE x.state END = a.area),
d AS (SELECT npi, d, count(*) AS m FROM (SELECT npi, unnest(detectors) AS d FROM r) GROUP BY 1, 2), t AS (SELECT npi, arg_min(d, (-m, d)) AS detector FROM d GROUP BY 1)
SELECT r.npi, scope, area, count(other) FILTER (WHERE other <> r.npi) AS others, CAST(coalesce(sum(dollars_c) FILTER (WHERE other <> r.npi), 0) AS BIGINT) AS dollars_c, any_value(detector) AS detector FROM r LEFT JOIN t USING (npi) GROUP BY r.npi, scope, area"""


def tools(spark, sf_dir):
    """Rows that each of the six tools finds about one network and one provider."""
    s, e, m = states(spark, sf_dir), events(spark, sf_dir), bill_month(spark, sf_dir)
    members = s.select(F.col("taxonomy").alias("community"), "npi", cents("balance").alias("paid"))
    tables_ = {
        "networks": members.groupBy("community").agg(F.count("*").alias("n")).withColumn("place", F.lit("ASIA")), "risk": s.select("npi", F.col("state").alias("place")), "members": members,
        "owners": s.where("npi % 3 = 0").select(F.col("taxonomy").alias("community"), "npi", "name"), "actions": e, "flags": m.select("npi", F.col("month_start").alias("month"), "paid_c"), "saturation": s.groupBy(F.col("state").alias("place"), "taxonomy").agg(F.count("*").alias("providers")),
    }
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(f"{kind}:{name}").alias("tool"), "n") for kind, subject, net in (("network", "T1", True), ("provider", "5", False)) for name, df in sv.subject_tools(tables_, subject, net).items()]
    from functools import reduce

    return reduce(lambda a, b: a.unionByName(b), parts)


def _tools_sql() -> str:
    out = []
    for kind, who, place in (("network", "SELECT npi FROM states WHERE taxonomy = 'T1'", "SELECT 'ASIA' AS place"), ("provider", "SELECT 5 AS npi", "SELECT state AS place FROM states WHERE npi = 5")):
        net = kind == "network"
        parts = {
            "subject": "SELECT 1 AS x FROM states WHERE taxonomy = 'T1' LIMIT 1" if net else "SELECT 1 FROM states WHERE npi = 5", "members": "SELECT 1 FROM states WHERE taxonomy = 'T1' LIMIT 60" if net else "SELECT 1 FROM states WHERE npi = 5",
            "owners": "SELECT 1 FROM states WHERE taxonomy = 'T1' AND npi % 3 = 0 LIMIT 120" if net else "SELECT 1 FROM states WHERE npi = 5 AND npi % 3 = 0", "list_actions": f"SELECT 1 FROM events_list WHERE npi IN ({who})",
            "payment_timeline": f"SELECT 1 FROM bill_month WHERE npi IN ({who}) LIMIT 200", "saturation": f"SELECT DISTINCT state, taxonomy FROM states WHERE state IN (SELECT place FROM ({place}))",
        }
        out += [f"SELECT '{kind}:{n}' AS tool, count(*) AS n FROM ({q})" for n, q in parts.items()]
    return f"WITH {STATES}, {EVENTS}, {BILL_MONTH} " + " UNION ALL ".join(out)


CASES = (("a", "SUPPLIER#000000001", "AFRICA"), ("b", "SUPPLIER#00000000", "ASIA"), ("c", "SUPPLIER", "EUROPE"), ("d", "NOBODY", "EUROPE"))


def cases(spark, sf_dir):
    """Known cases looked up by name and region, and where they turn up."""
    s = states(spark, sf_dir)
    found = {"lists": events(spark, sf_dir), "debt": s.where("balance < 0"), "paid": bill_month(spark, sf_dir)}
    return sv.case_profiles(spark.createDataFrame(list(CASES), "case string, pattern string, state string"), s, found)


CASES_SQL = f"""WITH {STATES}, {EVENTS}, {BILL_MONTH}, cs(k, p, st) AS (VALUES {', '.join(f"('{a}', '{b}', '{c}')" for a, b, c in CASES)}), h AS (SELECT k, npi FROM states JOIN cs ON state = st AND contains(upper(name), p) QUALIFY row_number() OVER (PARTITION BY k ORDER BY npi) <= 6),
f AS (SELECT npi, 'lists' AS found FROM events_list UNION SELECT npi, 'debt' FROM states WHERE balance < 0 UNION SELECT npi, 'paid' FROM bill_month)
SELECT k AS "case", count(DISTINCT h.npi) AS npis, CASE WHEN count(h.npi) > 0 THEN coalesce(string_agg(DISTINCT found, ',' ORDER BY found), '') END AS found FROM cs LEFT JOIN h USING (k) LEFT JOIN f ON f.npi = h.npi GROUP BY 1"""


def health(spark, sf_dir):
    return sv.checks({n: (table(spark, sf_dir, n), least) for n, least in (("region", 5), ("nation", 25), ("supplier", 10), ("lineitem", 10**9))})


HEALTH = " UNION ALL ".join(f"SELECT '{n}' AS \"table\", count(*) AS rows, CAST({least} AS BIGINT) AS least, count(*) >= {least} AS ok FROM {n}" for n, least in (("region", 5), ("nation", 25), ("supplier", 10), ("lineitem", 10**9)))

QUERIES = {
    "serve_verify_claims": (verify, VERIFY),
    "serve_prefix_search": (prefix, PREFIX),
    "serve_evidence_lines": (evidence, EVIDENCE),
    "serve_public_score": (public_score, PUBLIC),
    "serve_grounds": (grounds, GROUNDS),
    "serve_flag_kinds": (flag_kinds, FLAG_KINDS),
    "serve_packets": (packets, PACKETS),
    "serve_tier_counts": (tiers, TIERS),
    "serve_place_top": (place_top, PLACE_TOP),
    "serve_area": (area, AREA),
    "serve_tools": (tools, _tools_sql()),
    "serve_cases": (cases, CASES_SQL),
    "serve_health": (health, HEALTH),
}
