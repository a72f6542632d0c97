"""Networks of providers, people and places: typed edges, hubs, down-weighting, components, communities, features.

Nodes are strings kind:key; edges have src, dst, rel, weight. A provider's node has kind provider."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimlens.operators.graph import components
from claimlens.operators.robust import median_mad
from claimlens.session import discard, materialize

# How much a kind of link says.
WEIGHTS = {"owner": 1.0, "managing": 0.8, "governance": 0.6, "addr": 0.6, "unit": 1.0, "mail": 0.5, "phone": 0.8, "fax": 0.6, "ao": 0.9, "ein": 1.0, "secondary": 0.4, "chow": 0.7, "owner_addr": 0.5}
CROWDED = ("addr", "mail", "phone", "fax")


def node(kind: str, key) -> Column:
    """Null for null, blank and placeholder keys, which must not connect anything."""
    k = F.trim((F.col(key) if isinstance(key, str) else key).cast("string"))
    return F.when((k != "") & ~F.upper(k).isin("NAN", "NONE", "NULL"), F.concat(F.lit(f"{kind}:"), k))


def edges(parts: list[tuple[DataFrame, Column, Column, str, float | None]]) -> DataFrame:
    """Of (rows, source node, target node, relation, weight): one edge for each pair of nodes, with its largest weight and
    the relation that has it (the first by name among equals)."""
    rows = [df.select(s.alias("src"), d.alias("dst"), F.lit(rel).alias("rel"), F.lit(float(WEIGHTS[rel] if w is None else w)).alias("weight")) for df, s, d, rel, w in parts]
    x = reduce(DataFrame.unionByName, rows).where("src is not null and dst is not null and src != dst")
    x = x.withColumn("a", F.least("src", "dst")).withColumn("b", F.greatest("src", "dst"))
    return x.groupBy("a", "b").agg(F.max("weight").alias("weight"), F.min_by("rel", F.struct(-F.col("weight"), F.col("rel"))).alias("rel")).select(F.col("a").alias("src"), F.col("b").alias("dst"), "rel", "weight")


def kind_of(c) -> Column:
    return F.substring_index(c, ":", 1)


def _both(e: DataFrame) -> DataFrame:
    return e.select("src", "dst", "rel", "weight").unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "rel", "weight"))


def degrees(e: DataFrame) -> DataFrame:
    """node, degree, providers (neighbours that are providers)."""
    return _both(e).groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree"), F.count_if(kind_of("dst") == "provider").alias("providers"))


def hubs(e: DataFrame, limits: dict[str, int]) -> DataFrame:
    """Nodes with at least as many providers as their kind may have."""
    limit = F.element_at(F.create_map(*[x for k, v in sorted(limits.items()) for x in (F.lit(k), F.lit(v))]), kind_of("node"))
    return degrees(e).where(F.col("providers") >= limit)


def without(e: DataFrame, nodes: DataFrame, column: str = "node") -> DataFrame:
    n = nodes.select(F.col(column).alias("__n"))
    return e.join(n, F.col("src") == F.col("__n"), "left_anti").join(n, F.col("dst") == F.col("__n"), "left_anti")


def down_weight(e: DataFrame, least: int = 6) -> DataFrame:
    """Links through crowded places count 1/log2(1 + degree) as much."""
    d = degrees(e).where(kind_of("node").isin(*CROWDED) & (F.col("degree") >= least)).select("node", F.col("degree").alias("__d"))
    x = e.join(d.select(F.col("node").alias("src"), F.col("__d").alias("__s")), "src", "left").join(d.select(F.col("node").alias("dst"), F.col("__d").alias("__t")), "dst", "left")
    most = F.greatest(F.coalesce("__s", F.lit(0)), F.coalesce("__t", F.lit(0)))
    return x.withColumn("weight", F.when(most > 0, F.col("weight") / F.log2(1 + most)).otherwise(F.col("weight"))).select("src", "dst", "rel", "weight")


def provider_components(e: DataFrame, least: int = 2) -> DataFrame:
    """(node, component) of components with at least `least` providers."""
    c = components(e.select(F.col("src").alias("a"), F.col("dst").alias("b")))
    big = c.groupBy("component").agg(F.count_if(kind_of("node") == "provider").alias("p")).where(F.col("p") >= least).select("component")
    return c.join(big, "component", "left_semi").select("node", "component")


def _local_moving(n: int, a: np.ndarray, b: np.ndarray, w: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Weighted modularity (resolution 1) by local moves and aggregation; nodes in order, ties to the smaller community."""
    label = np.arange(n)
    total = w.sum()
    if total == 0:
        return label
    while True:
        near: list[dict[int, float]] = [{} for _ in range(n)]
        loop = np.zeros(n)
        for x, y, z in zip(a.tolist(), b.tolist(), w.tolist(), strict=True):
            if x == y:
                loop[x] += z
            else:
                near[x][y] = near[x].get(y, 0.0) + z
                near[y][x] = near[y].get(x, 0.0) + z
        k = np.array([sum(d.values()) for d in near]) + 2 * loop
        com = np.arange(n)
        size = k.copy()
        for _ in range(rounds):
            moved = False
            for x in range(n):
                size[com[x]] -= k[x]
                to: dict[int, float] = {}
                for y, z in near[x].items():
                    to[com[y]] = to.get(com[y], 0.0) + z
                best, gain = com[x], to.get(com[x], 0.0) - k[x] * size[com[x]] / (2 * total)
                for c, z in sorted(to.items()):
                    g = z - k[x] * size[c] / (2 * total)
                    if g > gain + 1e-12:
                        best, gain = c, g
                size[best] += k[x]
                if best != com[x]:
                    com[x], moved = best, True
            if not moved:
                break
        names, com = np.unique(com, return_inverse=True)
        label = com[label]
        if len(names) == n:
            return label
        a, b, n = com[a], com[b], len(names)


def _moved(links: DataFrame, rounds: int) -> DataFrame:
    """(node, community) by rounds of local moves over all tasks: each round, a third of the nodes go to the community
    of a neighbour with the best gain in modularity. The labels of the round with the best modularity are returned. For more nodes than an array of all may have; else see _moved_arrays."""
    both = links.where("src != dst").select("src", "dst", "weight")
    both = materialize(both.unionByName(both.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")).groupBy(F.col("src").alias("node"), F.col("dst").alias("to")).agg(F.sum("weight").alias("w")), "net-both")
    ends = links.select("component", F.explode(F.array("src", "dst")).alias("node"), "weight")
    total = links.groupBy("component").agg(F.sum("weight").alias("total")).where("total > 0")
    labels = materialize(ends.groupBy("component", "node").agg(F.sum("weight").alias("k")).join(total, "component").withColumn("community", F.col("node")), "net-labels")
    best, most = labels, None
    for r in range(rounds + 1):
        near = both.join(labels.select(F.col("node").alias("to"), "community"), "to").groupBy("node", "community").agg(F.sum("w").alias("w"))
        size = labels.groupBy("community").agg(F.sum("k").alias("size"), F.first("total").alias("total"))
        own = labels.select("node", "component", "k", "total", F.col("community").alias("now"))
        # a node's own community is a choice also without a neighbour in it
        choice = near.unionByName(labels.select("node", "community", F.lit(0.0).alias("w"))).groupBy("node", "community").agg(F.sum("w").alias("w"))
        choice = choice.join(own, "node").join(size.drop("total"), "community")
        gain = F.col("w") - F.col("k") * (F.col("size") - F.when(F.col("community") == F.col("now"), F.col("k")).otherwise(0.0)) / (2 * F.col("total"))
        choice = choice.withColumn("gain", gain)
        inside = materialize(choice.groupBy("node", "component", "k", "total", "now").agg(F.max_by("w", F.col("community") == F.col("now")).alias("w"), F.max_by("gain", F.col("community") == F.col("now")).alias("stay"), F.min_by(F.struct("community", "gain"), F.struct(-F.col("gain"), "community")).alias("go")), "net-moves")
        value = (inside.agg(F.sum(F.col("w") / (2 * F.col("total")))).first()[0] or 0.0) - (size.agg(F.sum((F.col("size") / (2 * F.col("total"))) ** 2)).first()[0] or 0.0)
        if most is None or value > most + 1e-12:
            best, most = labels, value
        better = F.col("go.gain") > F.col("stay") + 1e-12
        if r == rounds or not inside.where(better).limit(1).count():
            break
        turn = F.pmod(F.xxhash64("node") + r, F.lit(3)) == 0
        labels = materialize(inside.select("component", "node", "k", "total", F.when(better & turn, F.col("go.community")).otherwise(F.col("now")).alias("community")), "net-labels")
    return best.select("component", "node", "community")


#: Nodes of wide components up to which the communities of all are arrays that every task has (about 30 bytes a node);
#: with more, rounds of local moves join them.
MOST_NODES = 10_000_000
#: Ends of links in a packed row; a node with more has several rows.
PACKED = 1 << 19
PACKED_SQL = "s binary, d binary, w binary, part boolean"
ENDS = (np.int32, np.int32, np.float64)


def _packed(batches, size: int):
    """Rows (s, d, w) sorted by s, as rows of arrays. No row ends within a node, but for one with more than size ends: its
    rows are parts, which hold nothing else."""
    schema = pa.schema([("s", pa.binary()), ("d", pa.binary()), ("w", pa.binary()), ("part", pa.bool_())])
    row = lambda x, part: pa.record_batch([*(pa.array([c.tobytes()], pa.binary()) for c in x), pa.array([part])], schema=schema)
    kept, split = [np.zeros(0, t) for t in ENDS], None
    for x in batches:
        kept = [np.concatenate([a, c.to_numpy(zero_copy_only=False).astype(t)]) for a, c, t in zip(kept, x.columns, ENDS, strict=True)]
        while len(kept[0]) >= size:
            if split == kept[0][0]:
                at = min(size, int(np.searchsorted(kept[0], split, "right")))
            else:
                at = int(np.searchsorted(kept[0][:size], kept[0][size - 1]))
                split = None if at else kept[0][0]
                at = at or size
            yield row([c[:at] for c in kept], split is not None)
            kept = [c[at:] for c in kept]
            if split is not None and len(kept[0]) and kept[0][0] != split:
                split = None
    if split is not None and (at := int(np.searchsorted(kept[0], split, "right"))):
        yield row([c[:at] for c in kept], True)
        kept = [c[at:] for c in kept]
    if len(kept[0]):
        yield row(kept, False)


def _unpacked(batches):
    for x in batches:
        for s, d, w, part in zip(*(c.to_pylist() for c in x.columns), strict=True):
            yield *(np.frombuffer(c, t) for c, t in zip((s, d, w), ENDS, strict=True)), part


def _summed(a: np.ndarray, b: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct pairs in order, each with the sum of its weights."""
    key = a.astype(np.int64) << 32 | b
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return (key[first] >> 32).astype(np.int32), (key[first] & 0xFFFFFFFF).astype(np.int32), np.add.reduceat(w[order], first) if len(first) else w[:0]


def _best_moves(s: np.ndarray, c: np.ndarray, w: np.ndarray, com: np.ndarray, size: np.ndarray, k: np.ndarray, total: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Of distinct pairs (node, community near it) in order: the weight inside communities, the nodes with a better one than
    their own, and that one."""
    if not len(s):
        return 0.0, s, c
    own = c == com[s]
    gain = w - k[s] * (size[c] - np.where(own, k[s], 0.0)) / (2 * total[s])
    first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
    node = s[first]
    stay = np.add.reduceat(np.where(own, w, 0.0), first) - k[node] * (size[com[node]] - k[node]) / (2 * total[node])
    most = np.maximum.reduceat(gain, first)
    at = np.flatnonzero(gain == np.repeat(most, np.diff(np.append(first, len(s)))))
    go = c[at[np.searchsorted(at, first)]]
    better = most > stay + 1e-12
    return float((w[own] / (2 * total[s[own]])).sum()), node[better], go[better]


def _moved_arrays(packed: DataFrame, k: np.ndarray, total: np.ndarray, rounds: int) -> np.ndarray:
    """The community of each node (see _moved). Tasks read the links, the driver holds one number for each node."""
    sc, n = packed.sparkSession.sparkContext, len(k)
    fixed = sc.broadcast((k, total))
    com, best, most = np.arange(n, dtype=np.int32), None, None
    for r in range(rounds + 1):
        size = np.bincount(com, k, n)
        now = sc.broadcast((com, size))

        def moves(batches, now=now):
            com, size = now.value
            inside, nodes, to = 0.0, [], []
            for s, d, w, part in _unpacked(batches):
                s, c, w = _summed(s, com[d], w)
                if part:  # the driver adds up the parts of the node
                    yield pa.record_batch([pa.array([0.0]), pa.array([c.tobytes()]), pa.array([w.tobytes()]), pa.array([int(s[0])], pa.int32())], names=["inside", "a", "b", "node"])
                    continue
                x, node, go = _best_moves(s, c, w, com, size, *fixed.value)
                inside, nodes, to = inside + x, [*nodes, node], [*to, go]
            if nodes:
                yield pa.record_batch([pa.array([inside]), pa.array([np.concatenate(nodes).tobytes()]), pa.array([np.concatenate(to).tobytes()]), pa.array([None], pa.int32())], names=["inside", "a", "b", "node"])

        inside, nodes, to, parts = 0.0, [np.zeros(0, np.int32)], [np.zeros(0, np.int32)], []
        for x in packed.mapInArrow(moves, "inside double, a binary, b binary, node int").collect():
            if x.node is None:
                inside += x.inside
                nodes.append(np.frombuffer(x.a, np.int32))
                to.append(np.frombuffer(x.b, np.int32))
            else:
                c = np.frombuffer(x.a, np.int32)
                parts.append((np.full(len(c), x.node, np.int32), c, np.frombuffer(x.b, np.float64)))
        if parts:
            x, node, go = _best_moves(*_summed(*map(np.concatenate, zip(*parts, strict=True))), com, size, k, total)
            inside, nodes, to = inside + x, [*nodes, node], [*to, go]
        now.unpersist()
        value = inside - float(((size / (2 * total)) ** 2).sum())
        if most is None or value > most + 1e-12:
            best, most = com, value
        nodes, to = np.concatenate(nodes), np.concatenate(to)
        if r == rounds or not len(nodes):
            break
        turn = ((nodes.astype(np.int64) * 2654435761 >> 16) + r) % 3 == 0
        com = com.copy()
        com[nodes[turn]] = to[turn]
    fixed.unpersist()
    return best


def _pack(pairs: DataFrame) -> DataFrame:
    """Links (s, d, w) between numbers, both ways, packed."""
    both = pairs.where("s != d").select("s", "d", "w").unionByName(pairs.where("s != d").select(F.col("d").alias("s"), F.col("s").alias("d"), "w"))
    size = PACKED
    return materialize(both.repartition("s").sortWithinPartitions("s").mapInArrow(lambda it: _packed(it, size), PACKED_SQL), "net-packed")


def _numbered(links: DataFrame) -> DataFrame:
    """component, node, k (the weight of its ends), id (from 0 without gaps)."""
    ends = links.select("component", F.explode(F.array("src", "dst")).alias("node"), "weight")
    nodes = materialize(ends.groupBy("component", "node").agg(F.sum("weight").alias("k")), "net-nodes").withColumn("m", F.monotonically_increasing_id())
    nodes = materialize(nodes, "net-marked")
    part = F.shiftright("m", 33)
    starts, at = [], 0
    for p, n in sorted(nodes.groupBy(part.alias("p")).count().collect()):
        starts.append((p, at))
        at += n
    starts = F.broadcast(links.sparkSession.createDataFrame(starts, "p long, start long"))
    return materialize(nodes.withColumn("p", part).join(starts, "p").select("component", "node", "k", (F.col("start") + F.col("m").bitwiseAND((1 << 33) - 1)).cast("int").alias("id")), "net-ids")


def _coarser_arrays(links: DataFrame, nodes: DataFrame, most_edges: int, rounds: int) -> tuple[DataFrame, DataFrame]:
    """See _coarser. nodes: see _numbered."""
    spark = links.sparkSession
    names = sorted(r[0] for r in nodes.select("component").distinct().collect())  # few: each has more links than a task takes
    which = F.broadcast(spark.createDataFrame(list(enumerate(names)), "c int, component string"))
    x = nodes.join(which, "component").select("id", "k", "c").toArrow()
    order = np.argsort(x.column(0).to_numpy())
    k, comp = x.column(1).to_numpy()[order], x.column(2).to_numpy()[order]
    total = np.bincount(comp, k, len(names)) / 2
    ids = [nodes.select(F.col("node").alias(c), F.col("id").alias(i)) for c, i in (("src", "s"), ("dst", "d"))]
    pairs = materialize(links.join(ids[0], "src").join(ids[1], "dst").select("s", "d", F.col("weight").alias("w")), "net-pairs")
    found, size = np.arange(len(k), dtype=np.int32), None
    while True:
        packed = _pack(pairs)
        of = np.maximum(total[comp], 1e-300)  # nodes without weight stay where they are
        left, com = np.unique(_moved_arrays(packed, k, of, rounds), return_inverse=True)
        com = com.astype(np.int32).reshape(-1)
        found, k, comp = com[found], np.bincount(com, k, len(left)), comp[left]
        shared = spark.sparkContext.broadcast(com)

        def merged(batches, shared=shared):
            com = shared.value
            for b in batches:
                s, d = com[b.column(0).to_numpy()], com[b.column(1).to_numpy()]
                out = _summed(np.minimum(s, d), np.maximum(s, d), b.column(2).to_numpy())
                yield pa.record_batch([pa.array(c) for c in out], names=["s", "d", "w"])

        nxt = materialize(pairs.mapInArrow(merged, "s int, d int, w double").groupBy("s", "d").agg(F.sum("w").alias("w")), "net-merged")
        discard(pairs, packed)
        pairs = nxt
        shared_comp = spark.sparkContext.broadcast(comp)

        def placed(batches, shared=shared_comp):
            for b in batches:
                yield pa.record_batch([*b.columns, pa.array(shared.value[b.column(0).to_numpy()], pa.int32())], names=["s", "d", "w", "c"])

        placed_ = pairs.mapInArrow(placed, "s int, d int, w double, c int")
        counts = [r["count"] for r in placed_.groupBy("c").count().collect()]
        if sum(counts) == size or max(counts, default=0) <= most_edges:
            break
        size = sum(counts)
    text = lambda c: F.lpad(F.col(c).cast("string"), 10, "0")
    coarse = materialize(placed_.join(which, "c").select("component", text("s").alias("src"), text("d").alias("dst"), F.col("w").alias("weight")), "net-coarse")
    last = spark.sparkContext.broadcast(found)

    def named(batches):
        for b in batches:
            yield pa.record_batch([b.column(0), b.column(1), pa.array(last.value[b.column(2).to_numpy()], pa.int32())], names=["component", "node", "name"])

    of = nodes.select("component", "node", "id").mapInArrow(named, "component string, node string, name int")
    return materialize(of.select("component", "node", text("name").alias("name")), "net-names"), coarse


def _coarser(links: DataFrame, most_edges: int, rounds: int, most_nodes: int = MOST_NODES) -> tuple[DataFrame, DataFrame]:
    """(names, links): local moves and aggregation until every component has at most most_edges links between the
    aggregated nodes, or no move helps. names: node, component and the aggregated node it stands in. Up to most_nodes
    nodes are numbered, and their communities are arrays; more are joined."""
    nodes = _numbered(links)
    if nodes.count() <= most_nodes:
        return _coarser_arrays(links, nodes, most_edges, rounds)
    names, size = None, None
    while True:
        step = materialize(_moved(links, rounds), "net-step")
        to = step.drop("component")
        names = step.withColumnRenamed("community", "name") if names is None else materialize(names.join(to.withColumnRenamed("node", "name"), "name").select("component", "node", F.col("community").alias("name")), "net-names")
        src, dst = (to.select(F.col("node").alias(x), F.col("community").alias(f"c{x}")) for x in ("src", "dst"))
        links = links.join(src, "src").join(dst, "dst").select("component", F.least("csrc", "cdst").alias("src"), F.greatest("csrc", "cdst").alias("dst"), "weight")
        links = materialize(links.groupBy("component", "src", "dst").agg(F.sum("weight").alias("weight")), "net-coarse")
        n = links.count()
        if n == size or not links.groupBy("component").count().where(F.col("count") > most_edges).limit(1).count():
            return names, links
        size = n


def communities(e: DataFrame, members: DataFrame, split_over: int = 120, most_edges: int = 2_000_000, rounds: int = 30) -> DataFrame:
    """(node, community): components with more than `split_over` providers are split by modularity, the others stay
    whole. A component of up to `most_edges` links is split in one task; a larger one is first made smaller by rounds of
    local moves over all tasks. The objective is the usual one; no particular partition is promised beyond it."""
    p = members.groupBy("component").agg(F.count_if(kind_of("node") == "provider").alias("p"))
    links = materialize(e.join(members.select(F.col("node").alias("src"), "component"), "src").select("component", "src", "dst", F.col("weight").cast("double").alias("weight")), "net-links")
    many = links.groupBy("component").agg(F.count("*").alias("n"))
    large = materialize(p.join(many, "component").where(F.col("p") > split_over).select("component", "n"), "net-large")

    def split(x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values(["src", "dst"])
        nodes = np.unique(np.concatenate([x.src.to_numpy(str), x.dst.to_numpy(str)]))
        a, b = np.searchsorted(nodes, x.src.to_numpy(str)), np.searchsorted(nodes, x.dst.to_numpy(str))
        label = _local_moving(len(nodes), a, b, x.weight.to_numpy(float))
        first = {c: nodes[label == c][0] for c in np.unique(label)}
        return pd.DataFrame({"node": nodes, "community": [first[c] for c in label]})

    cut = links.join(large.where(F.col("n") <= most_edges), "component", "left_semi").groupBy("component").applyInPandas(split, "node string, community string")
    whole = members.join(large, "component", "left_anti").select("node", F.col("component").alias("community"))
    out = whole.unionByName(cut)
    wide = large.where(F.col("n") > most_edges)
    if not wide.limit(1).count():
        return out
    names, coarse = _coarser(materialize(links.join(wide, "component", "left_semi"), "net-wide"), most_edges, rounds)
    small = coarse.groupBy("component").count().where(F.col("count") <= most_edges).select("component")
    merged = coarse.join(small, "component", "left_semi").groupBy("component").applyInPandas(split, "node string, community string")
    named = names.join(merged.select(F.col("node").alias("name"), F.col("community").alias("merged")), "name", "left").select("component", "node", F.coalesce("merged", "name").alias("name"))
    named = materialize(named, "net-named")
    first = named.groupBy("component", "name").agg(F.min("node").alias("community"))
    return out.unionByName(named.join(first, ["component", "name"]).select("node", "community"))


def share_features(e: DataFrame, membership: DataFrame, kinds: list[str]) -> DataFrame:
    """Per community and kind: most members on one shared node, and shared nodes. A community whose shared nodes are all of
    other kinds has a row of zeros."""
    both = _both(e).where(kind_of("src") == "provider").join(membership.withColumnRenamed("node", "src"), "src")
    on = both.withColumn("kind", kind_of("dst")).groupBy("community", "kind", "dst").agg(F.countDistinct("src").alias("n")).where("n > 1")
    wide = on.groupBy("community").pivot("kind", sorted(kinds)).agg(F.max("n").alias("share"), F.count("n").alias("nodes"))
    return wide.na.fill(0)


def propagate(e: DataFrame, membership: DataFrame, labelled: DataFrame, through: dict[str, float]) -> DataFrame:
    """Credits of labelled nodes to communities: 1 for a member, the kind's credit for a neighbour of a member, each
    labelled node at its largest credit."""
    own = membership.join(labelled.select("node"), "node").select("community", "node", F.lit(1.0).alias("credit"))
    credit = F.element_at(F.create_map(*[x for k, v in sorted(through.items()) for x in (F.lit(k), F.lit(v))]), kind_of("dst"))
    near = _both(e).join(membership.withColumnRenamed("node", "src"), "src").join(labelled.select(F.col("node").alias("dst")), "dst", "left_semi").select("community", F.col("dst").alias("node"), credit.alias("credit")).where("credit is not null")
    return own.unionByName(near).groupBy("community", "node").agg(F.max("credit").alias("credit")).groupBy("community").agg(F.sum("credit").alias("credit"))


def owner_degrees(e: DataFrame, membership: DataFrame, kinds: list[str], least: float = 0.8, many: int = 3) -> DataFrame:
    """Per community: owners (nodes of these kinds), owner_multi (those with `many` member providers or more by links of at
    least `least`, so owning or managing ones), max_owner_degree, and governance_multi (those with as many by any link,
    but not by such)."""
    owners = membership.where(kind_of("node").isin(*kinds)).select("community", F.col("node").alias("src"))
    members = membership.where(kind_of("node") == "provider").select("community", F.col("node").alias("dst"), F.lit(True).alias("__in"))
    links = _both(e).select("src", "dst", "weight")
    x = owners.join(links, "src", "left").join(members, ["community", "dst"], "left")
    d = x.groupBy("community", "src").agg(F.count_if(F.col("__in") & (F.col("weight") >= least)).alias("owned"), F.count("__in").alias("governed"))
    return d.groupBy("community").agg(F.count("*").alias("owners"), F.count_if(F.col("owned") >= many).alias("owner_multi"), F.max("owned").alias("max_owner_degree"), F.count_if((F.col("governed") >= many) & (F.col("owned") < many)).alias("governance_multi"))


def chain_share(e: DataFrame, membership: DataFrame, chains: DataFrame, kinds: list[str]) -> DataFrame:
    """Per community: providers, those linked to a node of chains (node: known chains, and hubs) of these kinds, their
    share, and whether most are. e has the links to hubs too."""
    p = membership.where(kind_of("node") == "provider")
    hit = _both(e).where(kind_of("dst").isin(*kinds)).join(chains.select(F.col("node").alias("dst")).distinct(), "dst", "left_semi").select(F.col("src").alias("node")).distinct().withColumn("__chain", F.lit(True))
    g = p.join(hit, "node", "left").groupBy("community").agg(F.count("*").alias("n_prov"), F.count("__chain").alias("chain_members"))
    share = F.col("chain_members") / F.col("n_prov")
    return g.select("community", "n_prov", "chain_members", share.alias("chain_share"), (share >= 0.5).alias("is_chain"))


def market_z(rates: DataFrame, service: str, place: str, value: str) -> DataFrame:
    """rates with z: the robust z of log(1 + value) among all places with the service; a service whose places are all alike
    has its tiny deviations blown up rather than hidden."""
    x = rates.withColumn("__v", F.log1p(value))
    base = median_mad(x, [service], "__v").select(service, "med", "mad")
    z = 0.6745 * (F.col("__v") - F.col("med")) / F.when(F.col("mad") > 0, F.col("mad")).otherwise(1e-9)
    return x.join(base, service).withColumn("z", z).drop("__v", "med", "mad")


def payload(membership: DataFrame, e: DataFrame, hubs_: DataFrame | None = None) -> DataFrame:
    """Per community its members, its links among members and, of hubs_ (node), the hubs that its providers are linked to,
    as JSON. Communities are bounded by the split; hubs aren't followed further."""
    m = membership.groupBy("community").agg(F.array_sort(F.collect_list("node")).alias("nodes"))
    x = e.join(membership.select(F.col("node").alias("src"), "community"), "src").join(membership.select(F.col("node").alias("dst"), F.col("community").alias("c2")), "dst").where("community = c2")
    links = x.groupBy("community").agg(F.array_sort(F.collect_list(F.struct("src", "dst", "rel"))).alias("links"))
    m = m.join(links, "community", "left")
    if hubs_ is None:
        return m.select("community", F.to_json(F.struct("nodes", "links")).alias("graph"))
    near = _both(e).where(kind_of("src") == "provider").join(membership.select(F.col("node").alias("src"), "community"), "src").join(hubs_.select(F.col("node").alias("dst")), "dst", "left_semi")
    near = near.groupBy("community").agg(F.array_sort(F.collect_set("dst")).alias("hubs"), F.array_sort(F.collect_list(F.struct("src", "dst", "rel"))).alias("hub_links"))
    return m.join(near, "community", "left").select("community", F.to_json(F.struct("nodes", "links", "hubs", "hub_links")).alias("graph"))


def precision_at(df: DataFrame, score: str, unique: str, label: str, ks: list[int]) -> list[dict]:
    """k, hits, precision, base rate and the chance of as many hits by draws at the base rate. Top rows only are collected."""
    from math import comb

    n, pos = df.agg(F.count("*"), F.sum(F.col(label).cast("int"))).first()
    base = (pos or 0) / n if n else 0.0
    top = [bool(r[0]) for r in df.orderBy(F.col(score).desc_nulls_last(), unique).limit(max(ks)).select(label).collect()]
    out = []
    for k in ks:
        m = min(k, len(top))
        hits = sum(top[:m])
        tail = sum(comb(m, i) * base**i * (1 - base) ** (m - i) for i in range(hits, m + 1))
        out.append({"k": k, "hits": hits, "precision": hits / m if m else 0.0, "base_rate": base, "p_value": min(1.0, tail)})
    return out


def plazas(places: DataFrame, place: str, least: int = 8) -> DataFrame:
    """Places that host at least `least` members: members, kinds, new and labelled members. places has place, member,
    kind, is_new, labelled."""
    x = places.where(F.col(place).isNotNull()).groupBy(place).agg(F.countDistinct("member").alias("members"), F.countDistinct("kind").alias("kinds"), F.count_if("is_new").alias("new"), F.count_if("labelled").alias("labelled"))
    return x.where(F.col("members") >= least)


def dominant(members: DataFrame, community: str, columns: list[str]) -> DataFrame:
    """The most frequent value of each column per community (the smaller value among equals; nulls don't count)."""
    out = members.select(community).distinct()
    for c in columns:
        n = members.where(F.col(c).isNotNull()).groupBy(community, c).agg(F.count("*").alias("n"))
        out = out.join(n.groupBy(community).agg(F.min_by(c, F.struct(-F.col("n"), F.col(c))).alias(c)), community, "left")
    return out


def family_flags(structure: list[Column], label: list[Column], context: list[Column]) -> dict[str, Column]:
    """Whether any sign of each kind of evidence holds, and how many kinds do."""
    any_of = lambda cs: reduce(lambda a, b: a | b, [F.coalesce(c, F.lit(False)) for c in cs], F.lit(False))
    out = {"structure_family": any_of(structure), "label_family": any_of(label), "context_family": any_of(context)}
    return out | {"families": sum((c.cast("int") for c in out.values()), F.lit(0))}


def eligible(chain: Column, organisations: Column, families: Column, new: Column) -> Column:
    """Not a chain, at least three organisations, evidence of two kinds, something new."""
    return F.coalesce(~chain & (organisations >= 3) & (families >= 2) & (new >= 1), F.lit(False))
