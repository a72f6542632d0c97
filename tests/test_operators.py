import random
from datetime import date

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from claimlens.operators import network as net
from claimlens.operators import factors, fusion, graph, predict, serve, sets, volume
from claimlens.operators.blocking import _candidates, containing, pairs_in_blocks
from claimlens.operators.graph import components
from claimlens.operators.ranking import burst, framed_median, global_rank
from claimlens.operators.resolve import fit, resolve
from claimlens.operators.robust import median_mad, robust_z_filled
from claimlens.operators.temporal import day_window_join, month_window_join, months_between, workdays


def union_find(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(root)}


@pytest.mark.parametrize("links", [graph.LINKS, 1])
@pytest.mark.parametrize("kind", ["random", "path", "star", "empty", "loops"])
def test_components(spark, kind, links, monkeypatch):
    monkeypatch.setattr(graph, "LINKS", links)
    rnd = random.Random(5)
    edges = {
        "random": [(rnd.randrange(300), rnd.randrange(300)) for _ in range(220)],
        "path": [(i, i + 1) for i in range(200)],
        "star": [(7, i) for i in range(100, 160)],
        "empty": [],
        "loops": [(1, 1), (2, 3), (3, 2), (2, 3), (None, 4)],
    }[kind]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long").repartition(4)).collect()}
    assert got == union_find([e for e in edges if None not in e])


def test_windows(spark):
    e = spark.createDataFrame([(1, date(2020, 1, 31), date(2020, 4, 15))], "npi int, event_dt date, window_end date")
    m = spark.createDataFrame([(1, date(2020, i, 1)) for i in range(1, 8)], "npi int, month_start date")
    assert [r.month_start.month for r in month_window_join(m, e, "npi").orderBy("month_start").collect()] == [2, 3]
    c = spark.createDataFrame([(1, date(2020, 1, 31)), (1, date(2020, 2, 1)), (1, date(2020, 4, 15)), (1, date(2020, 4, 16))], "npi int, service_dt date")
    assert [str(r.service_dt) for r in day_window_join(c, e, "npi").orderBy("service_dt").collect()] == ["2020-02-01", "2020-04-15"]
    r = spark.range(1).select(months_between(F.lit("2024-01-31"), F.lit("2024-02-01")).alias("m"), workdays(F.lit("2024-02-01"), F.lit("2024-02-29")).alias("w")).first()
    assert (r.m, r.w) == (1, 21)


def test_ranks_and_medians(spark):
    df = spark.createDataFrame([(i, float((i * 37) % 101)) for i in range(500)], "id int, v double")
    got = {r.id: r.rank for r in global_rank(df, [F.col("v").desc(), F.col("id")]).collect()}
    want = sorted(range(500), key=lambda i: (-((i * 37) % 101), i))
    assert [got[i] for i in want] == list(range(1, 501))
    x = df.withColumn("k", F.lit(1)).withColumn("m", framed_median("v", ["k"], ["id"], 3)).orderBy("id").collect()
    assert x[0].m is None and x[3].m == np.median([x[0].v, x[1].v, x[2].v])
    b = spark.createDataFrame([(1, 0), (1, 5), (1, 90), (1, 96), (1, 97)], "k int, d int")
    assert burst(b, ["k"], "d", 90).first().most == 3


def test_robust(spark):
    df = spark.createDataFrame([(1, x) for x in (1.0, 2.0, 3.0, 4.0, 100.0)] + [(2, 5.0)] * 3, "k int, v double")
    r = {x.k: (x.n, x.med, x.mad) for x in median_mad(df, ["k"], "v").collect()}
    assert r == {1: (5, 3.0, 1.0), 2: (3, 5.0, 0.0)}
    z = [x.z for x in robust_z_filled(df.where("k = 1"), "v", "z").orderBy("v").collect()]
    assert z[2] == 0 and z[-1] == 5.0


def test_pairs_in_blocks(spark):
    df = spark.createDataFrame([(i, "a" if i < 30 else "b" if i < 34 else None) for i in range(40)], "id int, k string")
    got = {(r.a, r.b) for r in pairs_in_blocks(df, "id", F.col("k"), [], most=10, near=5).collect()}
    want = {(i, j) for i in range(30) for j in range(i + 1, min(30, i + 6))} | {(i, j) for i in range(30, 34) for j in range(i + 1, 34)}
    assert got == want


def test_em():
    rng = np.random.default_rng(1)
    levels = (3, 4, 3, 4, 3, 3)
    hit = np.stack([np.where(rng.random(200) < 0.9, s - 1, rng.integers(0, s, 200)) for s in levels], axis=1)
    miss = np.stack([rng.choice(s, 4000, p=[0.85] + [0.15 / (s - 1)] * (s - 1)) for s in levels], axis=1)
    rows, truth = np.concatenate([hit, miss]), np.arange(4200) < 200
    patterns, index, counts = np.unique(rows, axis=0, return_inverse=True, return_counts=True)
    f = fit(patterns, counts)
    accepted = f["posterior"][index] >= 0.95
    assert abs(f["lam"] - 200 / 4200) < 0.02
    assert (accepted & truth).sum() / accepted.sum() > 0.95 and (accepted & truth).sum() / 200 > 0.8


def test_resolve(spark):
    cols = "id int, state string, last string, first string, mi string, zip string, city string, street string"
    people = [(i, "CA", f"NAME{chr(65 + i)}X", f"FIRST{chr(65 + i)}", "J", f"9{i:04d}", f"C{i}", str(i)) for i in range(20)]
    people += [(100, "CA", "NAMEAX", "FIRSTA", "", "90000", "C0", "0")]
    person, audit = resolve(spark.createDataFrame(people, cols))
    got = {r.id: r.person for r in person.collect()}
    assert got[100] == got[0] == 0 and len(set(got.values())) == 20
    assert {"posterior", "weight", "matched"} <= set(audit.columns)


def test_network(spark):
    df = spark.createDataFrame([(1, "x", "p1"), (2, "x", "p1"), (3, "y", None), (4, "y", " "), (5, "NAN", "p2")], "id int, addr string, phone string")
    e = net.edges([(df, net.node("provider", "id"), net.node("addr", "addr"), "addr", None), (df, net.node("provider", "id"), net.node("phone", "phone"), "phone", None)])
    assert e.count() == 7
    comps = {r.node: r.component for r in net.provider_components(e).collect()}
    assert comps["provider:1"] == comps["provider:2"] != comps["provider:3"] == comps["provider:4"]
    assert "provider:5" not in comps
    assert {r.node for r in net.hubs(e, {"addr": 2, "phone": 3}).collect()} == {"addr:x", "addr:y"}


def test_share_features_of_communities_that_share_other_kinds_only(spark):
    e = spark.createDataFrame([(f"person:{x}" if x else "addr:a", f"provider:{i}", "r", 1.0) for i, x in ((1, 7), (2, 7), (3, 0), (4, 0))], "src string, dst string, rel string, weight double")
    m = spark.createDataFrame([(f"provider:{i}", "c" if i < 3 else "d") for i in range(1, 5)], "node string, community string")
    got = {r.community: (r.addr_share, r.addr_nodes, r.mail_share, r.mail_nodes) for r in net.share_features(e, m, ["addr", "mail"]).collect()}
    assert got == {"c": (0, 0, 0, 0), "d": (2, 1, 0, 0)}


def test_communities_refine_components(spark):
    edges = [(f"provider:{g}{i}", f"provider:{g}{j}") for g in "ab" for i in range(8) for j in range(i)] + [("provider:a0", "provider:b0")]
    e = spark.createDataFrame([(min(x), max(x), "addr", 1.0) for x in edges], "src string, dst string, rel string, weight double")
    m = net.provider_components(e)
    c = {r.node: r.community for r in net.communities(e, m, split_over=10).collect()}
    assert len(set(c.values())) == 2 and len({c[f"provider:a{i}"] for i in range(8)}) == 1
    assert len({r.community for r in net.communities(e, m, split_over=100).collect()}) == 1


def test_communities_split_components_beyond_one_task(spark):
    # three cliques of eight, linked in a ring
    links = [(f"provider:{c}{i}", f"provider:{c}{j}", 1.0) for c in "abc" for i in range(8) for j in range(i)]
    links += [("provider:a0", "provider:b1", 1.0), ("provider:b0", "provider:c1", 1.0), ("provider:c0", "provider:a1", 1.0)]
    e = spark.createDataFrame(links, "src string, dst string, weight double")
    nodes = sorted({x for a, b, _ in links for x in (a, b)})
    m = spark.createDataFrame([(x, nodes[0]) for x in nodes], "node string, component string")
    for most_edges in (1000, 50, 1):
        c = {r.node: r.community for r in net.communities(e, m, split_over=10, most_edges=most_edges).collect()}
        assert sorted(c) == nodes
        assert {c[x] for x in nodes} == {f"provider:{x}0" for x in "abc"} and all(c[x][9] == x[9] for x in nodes)


def test_wide_components_are_numbered_and_packed(spark, monkeypatch):
    """Arrays and joins find the cliques alike; nodes with more ends than a packed row holds have several."""
    links = [("c", f"{c}{i}", f"{c}{j}", 1.0) for c in "abc" for i in range(8) for j in range(i)] + [("c", "a0", "b1", 1.0), ("c", "b0", "c1", 1.0), ("c", "c0", "a1", 1.0)]
    df = spark.createDataFrame(links, "component string, src string, dst string, weight double")
    for size, most_nodes in ((1 << 19, 100), (3, 100), (1, 100), (3, 0)):
        monkeypatch.setattr(net, "PACKED", size)
        names, coarse = net._coarser(df, 50, 30, most_nodes)
        parts = {r.node: r.name for r in names.collect()}
        assert len(parts) == 24 and all(parts[x] == parts[y] for x in parts for y in parts if x[0] == y[0]) and len(set(parts.values())) == 3
        assert sum(r.weight for r in coarse.collect()) == len(links)
    rows = [(0, 1), (1, 0), (1, 2), (1, 3), (1, 4), (1, 5), (2, 1), (3, 1)]
    for size in range(1, 10):
        batch = pa.record_batch([pa.array([a for a, _ in rows], pa.int32()), pa.array([b for _, b in rows], pa.int32()), pa.array([1.0] * len(rows))], names=["s", "d", "w"])
        got = list(net._unpacked(net._packed([batch.slice(0, 4), batch.slice(4)], size)))
        assert [x for s, d, _, _ in got for x in zip(s.tolist(), d.tolist(), strict=True)] == rows
        whole = [set(s.tolist()) for s, _, _, part in got if not part]
        assert sum(map(len, whole)) == len(set().union(*whole)) and all(len(set(s.tolist())) == 1 for s, _, _, part in got if part)
        assert not {int(s[0]) for s, _, _, part in got if part} & set().union(*whole)


def test_sets(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    new = spark.createDataFrame([(2, "B"), (3, "c")], "id int, v string")
    assert sorted(map(tuple, sets.upsert(old, new, ["id"]).collect())) == [(1, "a"), (2, "B"), (3, "c")]
    assert sorted(map(tuple, sets.update_from(old, new, ["id"]).collect())) == [(1, "a"), (2, "B")]
    assert sorted(map(tuple, sets.replace_slice(old, new, "v", "a").collect())) == [(2, "B"), (2, "b"), (3, "c")]
    share = spark.range(10000).where(sets.hash_split("id", 0.3)).count()
    assert 2700 < share < 3300


def test_predict():
    rng = np.random.default_rng(0)
    p = rng.random(500)
    y = (rng.random(500) < p).astype(int)
    ci = predict.bootstrap(p, y, [50], rounds=100)
    assert ci["auc"][0] < ci["auc"][1] and ci["p@50"][0] > 0.6
    draws = predict.log_normal_draws(0.0, 0.5, 100)
    assert draws == sorted(draws) and len(draws) == 100


def test_auc(spark):
    df = spark.createDataFrame([(0.1, 0), (0.4, 0), (0.35, 1), (0.8, 1), (0.4, 1)], "s double, y int")
    assert abs(predict.auc(df, "s", "y").first().auc - (1 + 0 + 1 + 1 + 1 + 0.5) / 6) < 1e-12
    assert predict.auc(df.where("y = 1"), "s", "y").first().auc is None


def test_serve(spark):
    assert serve.parse_query("Jane Doe in Los Angeles, CA") == {"npi": None, "state": "CA", "city": "Los Angeles", "name": "Jane Doe"}
    assert serve.parse_query("1234567893")["npi"] == "1234567893"
    assert serve.parse_query("") == {"npi": None, "state": None, "city": None, "name": None}
    reg = spark.createDataFrame([("1234567893", "SUNRISE HOSPICE", "LA", "CA"), ("1093316739", "MOON CLINIC", "LA", "CA")], "npi string, name string, city string, state string")
    assert [r.name for r in serve.search(reg, "sunrise hospise CA").collect()] == ["SUNRISE HOSPICE"]
    assert [r.name for r in serve.search(reg, "109").collect()] == ["MOON CLINIC"]
    g = lambda *k: spark.range(1).select(serve.grounds(F.array(*map(F.lit, k)) if k else F.array().cast("array<string>")).alias("g")).first().g
    assert g("MEDICARE_REVOKED_PAID_AFTER", "unknown", "SAM_PAID_AFTER") == ["455.416(c)", "455.436", "455.23", "424.535(a)", "1001.1901"]
    assert g() == ["455.410"] == g("unknown")
    assert len(serve.GROUNDS) == 16 and set(serve.CAVEATS) <= set(serve.GROUNDS)
    ev = spark.createDataFrame([("1234567893", "X", date(2020, 1, 1), date(2020, 6, 1)), ("1234567893", "X", date(2020, 1, 1), date(2020, 6, 1))], "npi string, source string, event_dt date, window_end date")
    claims = spark.createDataFrame([("c1", date(2020, 6, 1), None, ["1234567893", "1234567893"], 5.0), ("c2", date(2020, 6, 2), None, ["1234567893"], 7.0), ("c3", None, None, None, 1.0)], "id string, start date, end date, npis array<string>, paid double")
    got = {r.id: (r.flagged, len(r.hits or [])) for r in serve.verify_claims(claims, ev).collect()}
    assert got == {"c1": (True, 1), "c2": (False, 0), "c3": (False, 0)}
    assert tuple(serve.verify_totals(serve.verify_claims(claims, ev)).first()) == (3, 1, 5.0)


def test_precision_and_similar_orgs(spark):
    from claimlens.operators.resolve import similar_orgs

    df = spark.createDataFrame([(i, float(i), i >= 90) for i in range(100)], "id int, s double, y boolean")
    got = net.precision_at(df, "s", "id", "y", [10, 20])
    assert (got[0]["hits"], got[0]["precision"], got[1]["hits"]) == (10, 1.0, 10) and got[0]["p_value"] < 1e-6 < got[1]["p_value"] * 1e9
    orgs = spark.createDataFrame([(1, "SUNRISE HOSPICE CARE", "CA"), (2, "SUNRISE HOSPICE CARE LLC", "CA"), (3, "SUNRISE HOSPICE CARE", "TX"), (4, "SUNSET DENTAL", "CA")], "id int, name string, state string")
    assert [(r.a, r.b) for r in similar_orgs(orgs, "id", "name", "state").collect()] == [(1, 2)]


def test_top_of_place_with_equal_ranks(spark):
    risk = spark.range(1000, 0, -1).select(F.col("id").alias("npi"), F.lit("X").alias("state"), F.pmod("id", F.lit(2)).alias("rank")).repartition(4)
    assert [r.npi for r in serve.top_of_place(risk, "state", "X", 5).collect()] == [2, 4, 6, 8, 10]


def test_profile_and_payload(spark):
    reg = spark.createDataFrame([("1", "A"), ("2", "B")], "npi string, name string")
    pay = spark.createDataFrame([("1", 5), ("1", 3)], "npi string, v int")
    r = serve.profile(reg, "1", {"pay": pay}).first()
    assert r.name == "A" and [x.v for x in r.pay] == [3, 5]
    m = spark.createDataFrame([("provider:1", "c"), ("provider:2", "c")], "node string, community string")
    e = spark.createDataFrame([("provider:1", "provider:2", "addr", 0.6)], "src string, dst string, rel string, weight double")
    assert '"src":"provider:1"' in net.payload(m, e).first().graph


def test_containing_looks_up_only_names_whose_runs_are_all_there(spark):
    # all share the run COMMON, one of the short names is in a long one
    name = lambda end: F.concat(F.lit("COMMON"), F.lpad(F.col("id").cast("string"), 6, "0"), F.lit(end)).alias("name")
    short = spark.range(300).select(F.col("id").alias("sid"), F.lit("X").alias("state"), name(""))
    long = spark.range(299, 599).select(F.col("id").alias("lid"), F.lit("X").alias("state"), name("Z"))
    assert _candidates(short, long, 6).count() == 1
    assert [tuple(r) for r in containing(short, long, 6).collect()] == [(299, 299)]
    twice = short.unionByName(short.withColumn("sid", F.col("sid") + 1000))
    assert _candidates(twice, long, 6).count() == 1 and sorted(r.sid for r in containing(twice, long, 6).collect()) == [299, 1299]


def test_containing(spark):
    rnd = random.Random(9)
    names = ["".join(rnd.choice("AB") for _ in range(rnd.randrange(1, 9))) for _ in range(60)]
    a = [(i, "X" if i % 3 else "Y", n) for i, n in enumerate(names[:30]) if len(n) >= 3]
    b = [(i, "X" if i % 2 else "Y", n) for i, n in enumerate(names[30:])]
    got = {(r.sid, r.lid) for r in containing(spark.createDataFrame(a, "sid long, state string, name string"), spark.createDataFrame(b, "lid long, state string, name string"), 3).collect()}
    assert got == {(i, j) for i, s, n in a for j, t, m in b if s == t and n in m} and got


def test_sampling(spark):
    df = spark.range(5000).withColumn("y", (F.col("id") % 50 == 0).cast("int"))
    assert sets.sample_rows(df, 200, "id", 1).count() == 200 and sets.sample_rows(df.limit(5), 200, "id").count() == 5
    one, two = ({r.id for r in sets.sample_rows(df.repartition(n), 50, "id", 1).collect()} for n in (2, 5))
    assert one == two != {r.id for r in sets.sample_rows(df, 50, "id", 2).collect()}
    shares = {r.y: r.s for r in df.groupBy("y").agg(F.avg(sets.stratified_split("id", "y", 0.7).cast("int")).alias("s")).collect()}
    assert abs(shares[0] - 0.7) < 0.03 and abs(shares[1] - 0.7) < 0.2


def test_umbrella_and_tiers(spark):
    volume = [(1, "1", 2, 0, 0, 0, 3, 10, 5), (2, "1", 2, 0, 0, 0, 3, 600, 5), (3, "1", 2, 0, 0, 0, 3, 10, 5), (4, "2", 1, 0, 0, 0, 1, 900, 5), (5, "1", 0, 1, 0, 0, 1, 900, 5), (6, "1", 0, 0, 1, 0, 1, 9, 5), (7, "1", 0, 0, 0, 0, 1, 9, 5)]
    df = spark.createDataFrame(volume, "npi long, entity_type string, impossible long, over_cap long, umbrella_months long, implausible long, orgs long, max_patients long, d2_c long")
    pairs = spark.createDataFrame([(i, "big") for i in range(100, 129)] + [(3, "big"), (1, "small")], "npi long, billing string")
    got = {r.npi: r.d2_tier for r in fusion.volume_findings(df, fusion.umbrella_size(pairs)).collect()}
    assert got == {1: "A", 2: "B", 3: "B", 4: "A", 5: "A", 6: "C"}


def test_outlook_bands(spark):
    zs = {"a": 1.0, "b": 0.3, "c": 0.0, "d": -0.3, "e": -2.0, "f": None}
    desk = spark.createDataFrame([(k, "velocity", z) for k, z in zs.items()], "community string, factor string, z double")
    got = {r.community: r.outlook for r in factors.momentum(desk).collect()}
    assert got == {"a": "rising fast", "b": "rising", "c": "steady", "d": "cooling", "e": "cooling", "f": None}
    assert len(factors.FACTORS) == 30 and set(factors.GIVEN) < set(factors.FACTORS)


def test_parse_query():
    parse = lambda t: {k: v for k, v in serve.parse_query(t).items() if v}
    assert parse("mayo clinic MN") == {"name": "mayo clinic", "state": "MN"}
    assert parse("we care transport in overland park kansas") == {"name": "we care transport", "city": "overland park", "state": "KS"}
    assert parse("smith, john west virginia") == {"name": "smith", "city": "john", "state": "WV"}
    assert parse("sunrise hospice, los angeles, CA") == {"name": "sunrise hospice", "city": "los angeles", "state": "CA"}
    assert parse("x 1234567893 y") == {"npi": "1234567893"}
    assert parse("in") == {"name": "in"} and parse("  ") == {}


def test_hubs_in_payload(spark):
    e = spark.createDataFrame([("provider:1", "addr:a", "addr", 1.0), ("provider:2", "addr:a", "addr", 1.0), ("provider:1", "mail:h", "mail", 1.0), ("provider:9", "mail:h", "mail", 1.0)], "src string, dst string, rel string, weight double")
    m = spark.createDataFrame([("provider:1", "c"), ("provider:2", "c"), ("addr:a", "c")], "node string, community string")
    import json

    graph_ = json.loads(net.payload(m, e, spark.createDataFrame([("mail:h",)], "node string")).first().graph)
    assert graph_["hubs"] == ["mail:h"] and len(graph_["links"]) == 2 and graph_["hub_links"] == [{"src": "provider:1", "dst": "mail:h", "rel": "mail"}]


def test_resolve_by_given_ids(spark):
    from claimlens.operators.listed import put_flags
    from claimlens.operators.resolve import resolve_orgs

    rows = [(1, "GOLDEN SUN HOSPICE", "CA", "a1"), (2, "OTHER NAME", "NV", "a1"), (3, "GOLDEN SUN HOSPICE", "CA", ""), (4, "GOLDEN SUN HOSPICE CARE", "CA", None), (5, "GOLDEN SUN HOSPICE", "TX", None), (6, None, "CA", "a1"), (7, "", None, None)]
    df = spark.createDataFrame(rows, "id long, key string, state string, associate string")
    assert {r.id: r.org for r in resolve_orgs(df).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 6: 6, 7: 7}
    people = spark.createDataFrame([(1, "CA", "SMITH", "ANN", "", "", "", "", "p9"), (2, "TX", "JONES", "BOB", "", "", "", "", "p9"), (3, "TX", "BROWN", "CAT", "", "", "", "", "")], "id long, state string, last string, first string, mi string, zip string, city string, street string, given string")
    assert {r.id: r.person for r in resolve(people, associate="given")[0].collect()} == {1: 1, 2: 1, 3: 3}
    flag = lambda i, d, x: (i, d, x, "{}")
    old = spark.createDataFrame([flag(1, "D2", 1.0), flag(2, "D3", 2.0)], "id long, detector string, dollars double, evidence string")
    new = spark.createDataFrame([flag(3, "D3", 5.0), flag(3, "D3", 7.0)], old.schema)
    assert sorted((r.id, r.dollars) for r in put_flags(old, new, "D3").collect()) == [(1, 1.0), (3, 7.0)]


def test_volume_baseline_keeps_no_written_lines(spark):
    from claimlens.plans import volume as plans

    assert "Expand" not in volume.month_rollup(_implied(spark), ["npi", "month_start"])._jdf.queryExecution().toString()
    left = _spend_files(spark)
    assert plans.baseline(spark, "/root/testdata/sf0.001").count() and _spend_files(spark) == left


def _implied(spark):
    cols = "npi long, month_start date, hours_lb double, hours_pt double, hours_cons double, personal_service boolean, paid_c long, lines long, patients int, billing long, hcpcs string, high_vector boolean, cap_hours double"
    return spark.createDataFrame([(1, date(2020, 1, 1), 1.0, 1.0, 1.0, True, 5, 1, 1, b, h, False, None) for b, h in ((7, "x"), (7, "y"), (8, "x"), (None, "x"))], cols)


def _spend_files(spark):
    from pathlib import Path

    from claimlens.session import shared_dir

    return set(Path(shared_dir(spark).removeprefix("file://")).glob("claimlens/*/spend-*"))


def test_volume_months_rounds_ties_as_its_sql(spark, tmp_path):
    """Hours whose exact value ends in a 5 in the fifth digit: 719.77375 and 1733.80625."""
    import duckdb

    from claimlens.plans import volume as plans

    c = duckdb.connect()
    for name in ("nation", "region", "supplier", "orders"):
        c.execute(f"create table {name} as from '/root/testdata/sf0.001/{name}.parquet'")
    supplier, order = c.execute("select min(s_suppkey) from supplier").fetchone()[0], c.execute("select min(o_orderkey) from orders").fetchone()[0]
    sizes = [7, 12, 30]
    c.execute(f"create table part as select i as p_partkey, 'Brand#11' as p_brand, 'STANDARD' as p_type, {sizes}[i] as p_size, 960.0::DOUBLE as p_retailprice from range(1, 4) t(i)")
    c.execute(f"""create table lineitem as select {order}::BIGINT as l_orderkey, part::BIGINT as l_partkey, {supplier}::BIGINT as l_suppkey, TIMESTAMP '1997-01-05' + to_months(month) as l_shipdate, 1.0::DOUBLE as l_quantity,
        price::DOUBLE as l_extendedprice, 1 as l_linenumber, 0.0::DOUBLE as l_tax, 0.0::DOUBLE as l_discount from (values (2, 0, 51823.71), (3, 1, 49933.62)) t(part, month, price) union all
        select {order}, 2, {supplier}, TIMESTAMP '1997-05-05', 1, 1000, 1, 0, 0 from range(30)""")
    for name in ("nation", "region", "supplier", "orders", "part", "lineitem"):
        c.execute(f"copy {name} to '{tmp_path}/{name}.parquet'")
    df = plans.months(spark, str(tmp_path))
    got, want = df.collect(), c.execute(f"select {', '.join(df.columns)} from ({plans.MONTHS})").fetchall()
    assert len(want) == 3 and sorted(map(tuple, got)) == sorted(want)


def test_month_rollup_counts_distinct(spark):
    r = volume.month_rollup(_implied(spark), ["npi", "month_start"]).first()
    assert (r.n_billing, r.n_codes, r.lines, r.hours_lb) == (2, 2, 4, 4.0)


def test_volume_top_keeps_no_written_lines(spark):
    from claimlens.plans import volume as plans

    left = _spend_files(spark)
    assert plans.top(spark, "/root/testdata/sf0.001").count() and _spend_files(spark) == left


def test_risk_fusion_writes_narrow_lines(spark):
    from claimlens.plans import procedures

    left = _spend_files(spark)
    procedures.fused(spark, "/root/testdata/sf0.001")
    (new,) = _spend_files(spark) - left
    assert not {"family", "enum_date"} & set(spark.read.parquet(str(new)).columns)
