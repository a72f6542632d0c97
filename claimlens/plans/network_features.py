"""Network features over the tables: plazas, dominant values, evidence families, eligibility, money of members."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimlens.operators import network as net
from claimlens.operators import factors as fd
from claimlens.plans import network
from claimlens.plans.data import SPEND, STATES, lines, r4, states, table
from claimlens.session import materialize


def plazas(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    key = F.col("s_suppkey")
    x = s.select(F.col("s_nationkey").cast("int").alias("place"), key.alias("member"), F.concat(F.lit("K"), (key % 3).cast("string")).alias("kind"), (key % 4 == 0).alias("is_new"), (F.col("s_acctbal") < 1000).alias("labelled"))
    return net.plazas(x, "place", 4)


PLAZAS = """SELECT CAST(s_nationkey AS INTEGER) AS place, count(DISTINCT s_suppkey) AS members, count(DISTINCT s_suppkey % 3) AS kinds, count(*) FILTER (WHERE s_suppkey % 4 = 0) AS new, count(*) FILTER (WHERE s_acctbal < 1000) AS labelled
FROM supplier GROUP BY 1 HAVING count(DISTINCT s_suppkey) >= 4"""


def _members(spark, sf_dir):
    """The registry's rows of the providers in a network."""
    m = network._members(spark, sf_dir)[1].where("node like 'provider:%'").select(F.split("node", ":")[1].cast("long").alias("npi"), F.col("component").alias("community"))
    return materialize(states(spark, sf_dir).join(m, "npi"), "net-providers")


MEMBERS = f"""{network.MEMBERS}, {STATES}, m AS (SELECT states.*, component AS community FROM states JOIN (SELECT CAST(split_part(node, ':', 2) AS BIGINT) AS npi, component FROM c JOIN big USING (component) WHERE node LIKE 'provider:%') USING (npi))"""


def dominant(spark, sf_dir):
    return net.dominant(_members(spark, sf_dir), "community", ["state", "nation", "taxonomy"])


DOMINANT = f"""{MEMBERS}, cm AS (SELECT DISTINCT community FROM m),
{', '.join(f"{x}_ AS (SELECT community, {x} FROM (SELECT community, {x}, count(*) AS n FROM m GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY community ORDER BY n DESC, {x}) = 1)" for x in ('state', 'nation', 'taxonomy'))}
SELECT community, state, nation, taxonomy FROM cm JOIN state_ USING (community) JOIN nation_ USING (community) JOIN taxonomy_ USING (community)"""


def ranked(spark, sf_dir):
    """Money of members, evidence families, eligibility and the composite score of each network."""
    money = lines(spark, sf_dir).groupBy("npi").agg(F.sum("paid_c").alias("paid_c"))
    x = _members(spark, sf_dir).join(money, "npi", "left").groupBy("community").agg(
        F.count("*").alias("n"), F.countDistinct("nation").alias("orgs"), F.sum(F.coalesce("paid_c", F.lit(0))).alias("paid_c"), F.count_if(F.col("enum_date") >= F.lit("1998-01-01").cast("date")).alias("new"),
        F.count_if(F.col("balance") < 0).alias("labelled"), F.max("balance").alias("top"),
    )
    f = net.family_flags([F.col("new") / F.col("n") >= 0.4, F.col("n") >= 3], [F.col("labelled") > 0], [F.col("top") >= 9500])
    x = x.select("*", *(c.alias(k) for k, c in f.items()))
    ok = net.eligible(F.col("community").endswith("5"), F.col("orgs"), F.col("families"), F.col("new"))
    return x.select("community", "n", "orgs", "paid_c", "new", "labelled", "families", ok.alias("eligible"), r4(1.5 * F.col("new") / F.col("n") + 2.0 * F.least(F.col("labelled"), F.lit(3)) + F.log10(F.col("paid_c") / 100 + 1)).alias("score"))


RANKED = f"""{MEMBERS}, {SPEND}, p AS (SELECT npi, CAST(sum(paid_c) AS BIGINT) AS paid_c FROM spend GROUP BY 1),
x AS (SELECT community, count(*) AS n, count(DISTINCT nation) AS orgs, CAST(sum(coalesce(paid_c, 0)) AS BIGINT) AS paid_c, count(*) FILTER (WHERE enum_date >= DATE '1998-01-01') AS new, count(*) FILTER (WHERE balance < 0) AS labelled, max(balance) AS top FROM m LEFT JOIN p USING (npi) GROUP BY 1),
f AS (SELECT *, CAST(CAST(new / n >= 0.4::DOUBLE OR n >= 3 AS INTEGER) + CAST(labelled > 0 AS INTEGER) + CAST(top >= 9500 AS INTEGER) AS INTEGER) AS families FROM x)
SELECT community, n, orgs, paid_c, new, labelled, families, community NOT LIKE '%5' AND orgs >= 3 AND families >= 2 AND new >= 1 AS eligible, round(1.5::DOUBLE * new / n + 2.0::DOUBLE * least(labelled, 3) + log10(paid_c / 100 + 1), 4) AS score FROM f"""

def desk(spark, sf_dir):
    """The factor desk of every network: thirty factors with percentile and z, and momentum with its outlook."""
    m = _members(spark, sf_dir)
    paid = lines(spark, sf_dir).groupBy("npi").agg(*(F.sum(F.when(F.col("year") == y, F.col("paid_c"))).alias(n) for y, n in ((1996, "paid_before"), (1998, "paid_last"))))
    segs = table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 100 + 1).alias("npi")).agg(F.countDistinct(F.col("o_orderkey") % 5).alias("n_states"))
    k = F.col("npi")
    members = m.join(paid, "npi", "left").join(segs, "npi", "left").select(
        "community", "npi", F.col("enum_date").alias("inc_dt"), F.date_add("enum_date", (k * 11 % 400).cast("int")).alias("enum_dt"), F.when(k % 6 == 0, F.lit("1999-01-01")).cast("date").alias("deact_dt"),
        F.coalesce("n_states", F.lit(0)).alias("n_states"), (F.col("balance") > 5000).alias("at_plaza"), F.coalesce("paid_before", F.lit(0)).alias("paid_before"), F.coalesce("paid_last", F.lit(0)).alias("paid_last"),
    )
    owners = m.select("community", (k % 9).alias("owner_id"), (k % 4 == 0).alias("is_manager"), F.date_add(F.lit("1996-01-01").cast("date"), (k * 17 % 600).cast("int")).alias("assoc_dt"))
    nets = m.groupBy("community").agg(F.count("*").alias("n_prov"), F.countDistinct("nation").alias("n_orgs"), *((F.sum(k % p) if p > 2 else F.max(k % 7)).alias(n) for p, n in enumerate(fd.GIVEN, 3)))
    out = fd.desk(nets, members, owners, m.where(k % 8 == 0).select("community"), new_since="1998-01-01", years_since=1994, today="2001-01-01")
    return out.select("community", "factor", "family", r4(F.col("value")).alias("value"), r4(F.col("percentile")).alias("percentile"), r4(F.col("z")).alias("z"), "outlook")


def _desk_sql() -> str:
    given = ", ".join(f"CAST(sum(npi % {p}) AS DOUBLE) AS {n}" for p, n in enumerate(fd.GIVEN, 3))
    names = [f for f in fd.FACTORS]
    signs = " ".join(f"WHEN '{f}' THEN {-1 if d == '-' else 1}" for f, (_, d) in fd.FACTORS.items())
    families = " ".join(f"WHEN '{f}' THEN '{x}'" for f, (x, _) in fd.FACTORS.items())
    return f"""{MEMBERS}, {SPEND}, pd AS (SELECT npi, CAST(sum(paid_c) FILTER (WHERE year = 1996) AS DOUBLE) AS pb, CAST(sum(paid_c) FILTER (WHERE year = 1998) AS DOUBLE) AS pl FROM spend GROUP BY 1),
sg AS (SELECT o_custkey % 100 + 1 AS npi, count(DISTINCT o_orderkey % 5) AS ns FROM orders GROUP BY 1),
mm AS (SELECT community, npi, nation, enum_date AS inc, enum_date + CAST(npi * 11 % 400 AS INTEGER) AS en, npi % 6 = 0 AS deact, coalesce(ns, 0) AS ns, balance > 5000 AS plaza, coalesce(pb, 0) AS pb, coalesce(pl, 0) AS pl FROM m LEFT JOIN pd USING (npi) LEFT JOIN sg USING (npi)),
nn AS (SELECT community, count(*) AS n_prov, count(DISTINCT nation) AS n_orgs, {given} FROM m GROUP BY 1),
vy AS (SELECT community, max(n) AS velocity FROM (SELECT community, year(inc) AS y, count(*) AS n FROM mm WHERE year(inc) >= 1994 GROUP BY 1, 2) GROUP BY 1),
ow AS (SELECT community, npi % 9 AS o, npi % 4 = 0 AS mg, DATE '1996-01-01' + CAST(npi * 17 % 600 AS INTEGER) AS dt FROM m),
ob AS (SELECT community, max(n) AS owner_burst FROM (SELECT a.community, a.dt, count(*) AS n FROM (SELECT DISTINCT community, dt FROM ow) a JOIN ow b ON a.community = b.community AND b.dt BETWEEN a.dt AND a.dt + 90 GROUP BY 1, 2) GROUP BY 1),
oa AS (SELECT community, count(DISTINCT o) AS n_owner, avg(CAST(mg AS INTEGER)) AS managing_share, count(*) AS n FROM ow GROUP BY 1), cw AS (SELECT community, count(*) AS chow FROM m WHERE npi % 8 = 0 GROUP BY 1),
ma AS (SELECT community, avg(CAST(inc >= DATE '1998-01-01' AS INTEGER)) * count(*) AS n_new, median(date_diff('day', inc, DATE '2001-01-01') / 365.25::DOUBLE) AS median_age, avg(CAST(plaza AS INTEGER)) AS plaza_share, sum(pb) AS pb, sum(pl) AS pl, max(pl) AS top, avg(CAST(pl > 0 AS INTEGER)) AS billing_share,
  avg(CAST(abs(date_diff('day', inc, en)) <= 183 AS INTEGER)) AS enum_near_inc, count(*) FILTER (WHERE deact) AS deactivated, max(ns) AS states FROM mm GROUP BY 1),
wide AS (SELECT community, {', '.join(f'CAST({n} AS DOUBLE) AS {n}' for n in fd.GIVEN)}, CAST(ma.n_new / greatest(n_orgs, 1) AS DOUBLE) AS new_share, CAST(coalesce(velocity, 0) AS DOUBLE) AS velocity, CAST(median_age AS DOUBLE) AS median_age, CAST(n_owner / n_prov AS DOUBLE) AS owners_per_provider, CAST(managing_share AS DOUBLE) AS managing_share,
  CAST(CASE WHEN oa.n >= 2 THEN owner_burst ELSE 0 END AS DOUBLE) AS owner_burst, CAST(coalesce(chow, 0) AS DOUBLE) AS chow, CAST(plaza_share AS DOUBLE) AS plaza_share, CAST(pl AS DOUBLE) AS medicaid_last, CAST(CASE WHEN pb > 0 THEN (pl - pb) / pb END AS DOUBLE) AS medicaid_growth, CAST(CASE WHEN pl > 0 THEN top / pl END AS DOUBLE) AS dollar_concentration,
  CAST(billing_share AS DOUBLE) AS billing_share, CAST(enum_near_inc AS DOUBLE) AS enum_near_inc, CAST(deactivated AS DOUBLE) AS deactivated, CAST(states AS DOUBLE) AS states FROM nn JOIN ma USING (community) JOIN oa USING (community) LEFT JOIN vy USING (community) LEFT JOIN ob USING (community) LEFT JOIN cw USING (community) WHERE n_prov >= 3),
t AS (FROM wide UNPIVOT INCLUDE NULLS (value FOR factor IN ({', '.join(names)}))), b AS (SELECT factor, median(value) AS med, count(value) AS cnt FROM t GROUP BY 1), dv AS (SELECT factor, any_value(med) AS med, any_value(cnt) AS cnt, median(abs(value - med)) AS mad FROM t JOIN b USING (factor) GROUP BY 1),
rr AS (SELECT *, (rank() OVER (PARTITION BY factor ORDER BY value) + (count(*) OVER (PARTITION BY factor, value) - 1) / 2) / count(*) OVER (PARTITION BY factor) AS rk FROM t WHERE value IS NOT NULL),
zz AS (SELECT t.community, t.factor, t.value, CASE t.factor {signs} END AS sg, CASE WHEN cnt >= 5 THEN rk END AS rk, cnt, CASE WHEN cnt >= 5 AND t.value IS NOT NULL THEN CASE WHEN mad > 0 THEN (t.value - med) / (1.4826::DOUBLE * mad) ELSE 0 END END AS z0 FROM t JOIN dv USING (factor) LEFT JOIN rr ON rr.community = t.community AND rr.factor = t.factor),
fin AS (SELECT community, factor, CASE factor {families} END AS family, value, 100 * CASE WHEN sg < 0 THEN 1 - rk + 1 / cnt ELSE rk END AS percentile, sg * z0 AS z FROM zz),
mo AS (SELECT community, avg(greatest(-3, least(3, z))) AS v FROM fin WHERE factor IN ({', '.join(f"'{f}'" for f in fd.MOMENTUM)}) GROUP BY 1),
mp AS (SELECT *, (rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2) / count(*) OVER () AS rk FROM mo WHERE v IS NOT NULL)
SELECT community, factor, family, round(value, 4) + 0.0::DOUBLE AS value, round(percentile, 4) AS percentile, round(z, 4) + 0.0::DOUBLE AS z, CAST(NULL AS VARCHAR) AS outlook FROM fin
UNION ALL SELECT mo.community, 'momentum', 'momentum', round(mo.v, 4) + 0.0::DOUBLE, round(100 * rk, 4), NULL, CASE WHEN mo.v >= 1 THEN 'rising fast' WHEN mo.v >= 0.3::DOUBLE THEN 'rising' WHEN mo.v > -0.3::DOUBLE THEN 'steady' WHEN mo.v IS NOT NULL THEN 'cooling' END FROM mo LEFT JOIN mp USING (community)"""


QUERIES = {
    "net_factor_desk": (desk, _desk_sql()),
    "net_plazas": (plazas, PLAZAS),
    "net_dominant": (dominant, DOMINANT),
    "net_ranked": (ranked, RANKED),
}
