"""Entity resolution and provider networks over the tables: suppliers are providers, linked through customers' segments,
nations, shared balances and parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimlens.operators import network as net
from claimlens.operators.graph import components
from claimlens.operators.resolve import resolve
from claimlens.operators.robust import robust_z_filled
from claimlens.plans.data import r4, table
from claimlens.session import materialize, sweep


def _edges(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    key = F.col("s_suppkey")
    p = net.node("provider", "s_suppkey")
    sold = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey").distinct()
    person = net.node("person", "s_nationkey")
    return net.edges([
        (s, p, net.node("addr", F.floor(F.col("s_acctbal") / 150).cast("string")), "addr", None),
        (s, p, net.node("phone", F.when(key % 3 == 0, F.concat((key % 20).cast("string"), F.lit("-"), F.col("s_nationkey").cast("string")))), "phone", None),
        (s.where(key % 11 == 0), p, net.node("owner", F.col("s_nationkey")), "owner", None),
        (s.where(key % 11 == 0), p, net.node("owner", F.col("s_nationkey")), "managing", None),
        (s.where(key % 7 == 0), p, person, "governance", None),
        (s.where(key % 5 == 0), p, person, "managing", None),
        (sold, net.node("provider", "l_suppkey"), net.node("mail", "l_partkey"), "mail", None),
    ])


EDGES = """s AS (SELECT s_suppkey, 'provider:' || s_suppkey AS p, s_acctbal, s_nationkey FROM supplier),
e0 AS (SELECT p AS x, 'addr:' || CAST(floor(s_acctbal / 150) AS BIGINT) AS y, 'addr' AS rel, 0.6::DOUBLE AS w FROM s
  UNION ALL SELECT p, 'phone:' || (s_suppkey % 20) || '-' || s_nationkey, 'phone', 0.8 FROM s WHERE s_suppkey % 3 = 0
  UNION ALL SELECT p, 'owner:' || s_nationkey, 'owner', 1.0 FROM s WHERE s_suppkey % 11 = 0 UNION ALL SELECT p, 'owner:' || s_nationkey, 'managing', 0.8 FROM s WHERE s_suppkey % 11 = 0
  UNION ALL SELECT p, 'person:' || s_nationkey, 'governance', 0.6 FROM s WHERE s_suppkey % 7 = 0 UNION ALL SELECT p, 'person:' || s_nationkey, 'managing', 0.8 FROM s WHERE s_suppkey % 5 = 0
  UNION ALL SELECT DISTINCT 'provider:' || l_suppkey, 'mail:' || l_partkey, 'mail', 0.5 FROM lineitem),
e AS (SELECT least(x, y) AS src, greatest(x, y) AS dst, arg_min(rel, (-w, rel)) AS rel, max(w) AS weight FROM e0 GROUP BY 1, 2),
both_ AS (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e), deg AS (SELECT src AS node, count(*) AS degree, count(*) FILTER (WHERE dst LIKE 'provider:%') AS providers FROM both_ GROUP BY 1)"""


def edges(spark, sf_dir):
    return _edges(spark, sf_dir)


LIMITS = {"addr": 3, "phone": 4, "owner": 5, "person": 9, "mail": 3}
HUBS = f"WITH {EDGES} SELECT node, degree, providers FROM deg WHERE providers >= CASE split_part(node, ':', 1) WHEN 'addr' THEN 3 WHEN 'phone' THEN 4 WHEN 'owner' THEN 5 WHEN 'person' THEN 9 WHEN 'mail' THEN 3 END"


def hubs(spark, sf_dir):
    return net.hubs(_edges(spark, sf_dir), LIMITS)


def down_weight(spark, sf_dir):
    x = net.down_weight(_edges(spark, sf_dir), 3)
    return x.select("src", "dst", "rel", r4(F.col("weight")).alias("weight"))


DOWN = f"""WITH {EDGES}, c AS (SELECT node, degree FROM deg WHERE split_part(node, ':', 1) IN ('addr', 'mail', 'phone', 'fax') AND degree >= 3)
SELECT src, dst, rel, round(CASE WHEN greatest(coalesce(a.degree, 0), coalesce(b.degree, 0)) > 0 THEN weight / log2(1 + greatest(coalesce(a.degree, 0), coalesce(b.degree, 0))) ELSE weight END, 4) AS weight
FROM e LEFT JOIN c a ON a.node = src LEFT JOIN c b ON b.node = dst"""


def _graph(spark, sf_dir):
    """Edges, those without hubs, hubs, and the components that the latter leave."""
    e = materialize(_edges(spark, sf_dir), "net-edges")
    h = materialize(net.hubs(e, LIMITS), "net-hubs")
    free = materialize(net.without(e, h), "net-free")
    return e, free, h, net.provider_components(free)


def _members(spark, sf_dir):
    _, free, _, m = _graph(spark, sf_dir)
    return free, m


MEMBERS = f"""WITH RECURSIVE {EDGES}, hub AS ({HUBS[HUBS.index('SELECT node, degree'):]}), k AS (SELECT src, dst FROM e WHERE src NOT IN (SELECT node FROM hub) AND dst NOT IN (SELECT node FROM hub)),
n AS (SELECT src, dst FROM k UNION SELECT dst, src FROM k UNION SELECT src, src FROM k UNION SELECT dst, dst FROM k),
r(node, component) USING KEY (node) AS (SELECT src, min(dst) FROM n GROUP BY 1 UNION SELECT n.src, min(x.component) FROM r x JOIN n ON n.dst = x.node JOIN recurring.r o ON o.node = n.src GROUP BY n.src HAVING min(x.component) < min(o.component)), c AS (SELECT node, component FROM r),
big AS (SELECT component FROM c GROUP BY 1 HAVING count(*) FILTER (WHERE node LIKE 'provider:%') >= 2)"""


def members(spark, sf_dir):
    return _members(spark, sf_dir)[1]


def shares(spark, sf_dir):
    e, m = _members(spark, sf_dir)
    x = net.share_features(e, m.withColumnRenamed("component", "community"), ["addr", "phone", "mail", "owner"])
    return x.select("community", *(F.col(c).cast("long").alias(c) for c in x.columns if c != "community"))


SHARES = f"""{MEMBERS}, m AS (SELECT c.* FROM c JOIN big USING (component) WHERE node LIKE 'provider:%'), x AS (SELECT src, dst FROM k UNION ALL SELECT dst, src FROM k),
o AS (SELECT component AS community, split_part(dst, ':', 1) AS kind, dst, count(DISTINCT src) AS n FROM x JOIN m ON node = src GROUP BY 1, 2, 3 HAVING count(DISTINCT src) > 1)
SELECT community, {', '.join(f"CAST(coalesce(max(n) FILTER (WHERE kind = '{x}'), 0) AS BIGINT) AS {x}_share, CAST(count(*) FILTER (WHERE kind = '{x}') AS BIGINT) AS {x}_nodes" for x in ('addr', 'phone', 'mail', 'owner'))} FROM o GROUP BY 1"""


def propagate(spark, sf_dir):
    """Credit of labelled providers and owners to networks."""
    e, m = _members(spark, sf_dir)
    lab = table(spark, sf_dir, "supplier").where("s_acctbal < 2500").select(net.node("provider", "s_suppkey").alias("node"))
    lab = lab.unionByName(table(spark, sf_dir, "nation").where("n_nationkey < 12").select(net.node("owner", "n_nationkey").alias("node")))
    only = m.where(net.kind_of("node") == "provider").withColumnRenamed("component", "community")
    return net.propagate(e, only, lab, {"owner": 1.0, "addr": 0.5})


PROPAGATE = f"""{MEMBERS}, m AS (SELECT c.* FROM c JOIN big USING (component) WHERE node LIKE 'provider:%'), x AS (SELECT src, dst FROM k UNION ALL SELECT dst, src FROM k),
lab AS (SELECT 'provider:' || s_suppkey AS node FROM supplier WHERE s_acctbal < 2500 UNION SELECT 'owner:' || n_nationkey FROM nation WHERE n_nationkey < 12),
cr AS (SELECT component AS community, node, 1.0::DOUBLE AS credit FROM m JOIN lab USING (node) UNION ALL SELECT component, dst, CASE split_part(dst, ':', 1) WHEN 'owner' THEN 1.0::DOUBLE ELSE 0.5 END FROM x JOIN m ON m.node = src WHERE dst IN (SELECT node FROM lab) AND split_part(dst, ':', 1) IN ('owner', 'addr'))
SELECT community, sum(credit) AS credit FROM (SELECT community, node, max(credit) AS credit FROM cr GROUP BY 1, 2) GROUP BY 1"""


def scores(spark, sf_dir):
    """Robust z-scores of network features over all networks, clipped, and their weighted sum."""
    _, m = _members(spark, sf_dir)
    f = m.groupBy("component").agg(F.count_if(net.kind_of("node") == "provider").alias("n_prov"), F.count("*").alias("n_nodes"))
    f = robust_z_filled(robust_z_filled(f, "n_prov", "z_prov"), "n_nodes", "z_nodes")
    return f.select("component", "n_prov", "n_nodes", r4(1.5 * F.col("z_prov") + 0.5 * F.col("z_nodes")).alias("score"))


SCORES = f"""{MEMBERS}, f AS (SELECT component, count(*) FILTER (WHERE node LIKE 'provider:%') AS n_prov, count(*) AS n_nodes FROM c JOIN big USING (component) GROUP BY 1),
sx AS (SELECT *, median(n_prov) OVER () AS m1, median(n_nodes) OVER () AS m2, coalesce(nullif(stddev_samp(n_prov) OVER (), 0), 1) AS d1, coalesce(nullif(stddev_samp(n_nodes) OVER (), 0), 1) AS d2 FROM f),
t AS (SELECT *, median(abs(n_prov - m1)) OVER () AS a1, median(abs(n_nodes - m2)) OVER () AS a2 FROM sx)
SELECT component, n_prov, n_nodes, round(1.5::DOUBLE * greatest(-5, least(5, (n_prov - m1) / CASE WHEN a1 > 0 THEN a1 / 0.6745::DOUBLE ELSE d1 END)) + 0.5::DOUBLE * greatest(-5, least(5, (n_nodes - m2) / CASE WHEN a2 > 0 THEN a2 / 0.6745::DOUBLE ELSE d2 END)), 4) + 0.0::DOUBLE AS score FROM t"""


def graph_components(spark, sf_dir):
    """Components of suppliers and the customers whose orders have one line only; the smallest node names each."""
    li = table(spark, sf_dir, "lineitem")
    single = li.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.min("l_suppkey").alias("s")).where("n = 1")
    o = table(spark, sf_dir, "orders")
    e = o.join(single, o.o_orderkey == single.l_orderkey).select((F.col("s") * 2).alias("a"), (F.col("o_custkey") * 2 + 1).alias("b"))
    return components(e)


GRAPH_COMPONENTS = """WITH RECURSIVE k AS (SELECT DISTINCT s * 2 AS a, o_custkey * 2 + 1 AS b FROM orders JOIN (SELECT l_orderkey, min(l_suppkey) AS s FROM lineitem GROUP BY 1 HAVING count(*) = 1) ON o_orderkey = l_orderkey), n AS (SELECT a AS x, b AS y FROM k UNION SELECT b, a FROM k UNION SELECT a, a FROM k UNION SELECT b, b FROM k),
r(node, component) USING KEY (node) AS (SELECT x, min(y) FROM n GROUP BY 1 UNION SELECT n.x, min(q.component) FROM r q JOIN n ON n.y = q.node JOIN recurring.r o ON o.node = n.x GROUP BY n.x HAVING min(q.component) < min(o.component)) SELECT node, component FROM r"""


def owner_degrees(spark, sf_dir):
    """Owners of several providers in a network, and governors of several without owning as many."""
    e, m = _members(spark, sf_dir)
    return net.owner_degrees(e, m.withColumnRenamed("component", "community"), ["owner", "person"], many=2)


OWNER_DEGREES = f"""{MEMBERS}, m AS (SELECT c.* FROM c JOIN big USING (component)), ke AS (SELECT e.* FROM e JOIN k USING (src, dst)), x AS (SELECT src, dst, weight FROM ke UNION ALL SELECT dst, src, weight FROM ke),
d AS (SELECT m.component AS community, m.node, count(*) FILTER (WHERE p.node IS NOT NULL AND weight >= 0.8::DOUBLE) AS owned, count(p.node) AS governed FROM m LEFT JOIN x ON x.src = m.node LEFT JOIN m p ON p.node = x.dst AND p.component = m.component AND p.node LIKE 'provider:%' WHERE split_part(m.node, ':', 1) IN ('owner', 'person') GROUP BY 1, 2)
SELECT community, count(*) AS owners, count(*) FILTER (WHERE owned >= 2) AS owner_multi, max(owned) AS max_owner_degree, count(*) FILTER (WHERE governed >= 2 AND owned < 2) AS governance_multi FROM d GROUP BY 1"""


def chain_share(spark, sf_dir):
    """Share of a network's providers with a chain among their owners, or a hub that owns too many to tell."""
    e, _, h, m = _graph(spark, sf_dir)
    chains = table(spark, sf_dir, "nation").where("n_nationkey % 4 = 0").select(net.node("person", "n_nationkey").alias("node"))
    x = net.chain_share(e, m.withColumnRenamed("component", "community"), chains.unionByName(h.select("node")), ["owner", "person"])
    return x.withColumn("chain_share", r4(F.col("chain_share")))


CHAIN_SHARE = f"""{MEMBERS}, m AS (SELECT c.* FROM c JOIN big USING (component) WHERE node LIKE 'provider:%'), x AS (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e),
ch AS (SELECT 'person:' || n_nationkey AS node FROM nation WHERE n_nationkey % 4 = 0 UNION SELECT node FROM hub), p AS (SELECT DISTINCT src AS node FROM x WHERE dst IN (SELECT node FROM ch) AND split_part(dst, ':', 1) IN ('owner', 'person'))
SELECT component AS community, count(*) AS n_prov, count(p.node) AS chain_members, round(count(p.node) / count(*), 4) AS chain_share, count(p.node) / count(*) >= 0.5::DOUBLE AS is_chain FROM m LEFT JOIN p USING (node) GROUP BY 1"""


def market(spark, sf_dir):
    """How crowded a place is for a service against all places, on a log scale."""
    c = table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("service"), F.col("c_nationkey").cast("int").alias("place")).agg((F.count("*") / 7.0).alias("rate"))
    return net.market_z(c, "service", "place", "rate").select("service", "place", r4(F.col("rate")).alias("rate"), r4(F.col("z")).alias("z"))


MARKET = """WITH c AS (SELECT c_mktsegment AS service, CAST(c_nationkey AS INTEGER) AS place, count(*) / 7.0::DOUBLE AS rate FROM customer GROUP BY 1, 2), m AS (SELECT service, median(ln(1 + rate)) AS med FROM c GROUP BY 1),
d AS (SELECT service, any_value(med) AS med, median(abs(ln(1 + rate) - med)) AS mad FROM c JOIN m USING (service) GROUP BY 1)
SELECT service, place, round(rate, 4) AS rate, round(0.6745::DOUBLE * (ln(1 + rate) - med) / CASE WHEN mad > 0 THEN mad ELSE 1e-9::DOUBLE END, 4) + 0.0::DOUBLE AS z FROM c JOIN d USING (service)"""


def communities(spark, sf_dir):
    """Networks of many providers split by modularity. No SQL: the partition is only held to refine the components."""
    e = materialize(_edges(spark, sf_dir), "net-edges")
    sweep(spark)
    return net.communities(e, materialize(net.provider_components(e), "net-members"), split_over=20)


def resolved(spark, sf_dir):
    """People made of customers with misspelt copies, resolved. No SQL: the model is fitted by iteration."""
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    names = F.array(*map(F.lit, ("ANDERSON", "BAKER", "CASTILLO", "DONOVAN", "ESTRADA", "FITZGERALD", "GUTIERREZ", "HARRINGTON", "IVERSON", "JEFFERSON")))
    firsts = F.array(*map(F.lit, ("ROBERT", "MARIA", "JOHN", "PATRICIA", "MICHAEL", "LINDA", "WILLIAM")))
    base = c.select(k.alias("id"), (F.col("c_nationkey") % 5).alias("state"), F.element_at(names, (k * 7 % 10 + 1).cast("int")).alias("last"), F.element_at(firsts, (k * 5 % 7 + 1).cast("int")).alias("first"), F.element_at(F.array(*map(F.lit, "ABCDEFGHIJ")), (k % 10 + 1).cast("int")).alias("mi"), F.lpad((k * 31 % 90000 + 10000).cast("string"), 5, "0").alias("zip"), F.col("c_mktsegment").alias("city"), F.concat((k % 97).cast("string"), F.lit(" MAIN ST")).alias("street"))
    copy = base.where("id % 4 = 0").select((F.col("id") + 1_000_000).alias("id"), "state", F.concat("last", F.lit("S")).alias("last"), "first", F.lit("").alias("mi"), "zip", "city", "street")
    return resolve(base.unionByName(copy))[0]


QUERIES = {
    "net_edges": (edges, f"WITH {EDGES} SELECT src, dst, rel, weight FROM e"),
    "net_hubs": (hubs, HUBS),
    "net_down_weight": (down_weight, DOWN),
    "net_components": (members, f"{MEMBERS} SELECT node, component FROM c JOIN big USING (component)"),
    "net_share_features": (shares, SHARES),
    "net_label_propagation": (propagate, PROPAGATE),
    "net_scores": (scores, SCORES),
    "net_owner_degrees": (owner_degrees, OWNER_DEGREES),
    "net_chain_share": (chain_share, CHAIN_SHARE),
    "net_market": (market, MARKET),
    "graph_components": (graph_components, GRAPH_COMPONENTS),
    "net_communities": (communities, None),
    "entity_resolution": (resolved, None),
}
