"""Graph operators: connected components."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimlens.session import counted, discard, materialize


#: Links that a task contracts, on average, once each partition's own links are contracted.
LINKS = 10_000


def _forest(batches, roots: bool = False):
    """The links of a partition, replaced by one link from each node to the smallest node it reaches in them (itself,
    if it has no link but to itself, or in any case with roots)."""
    root: dict = {}

    def find(x):
        while (y := root.get(x, x)) != x:
            root[x] = root.get(y, y)
            x = y
        return x

    kind = None
    for x in batches:
        kind = x.schema
        for a, b in zip(x.column(0).to_pylist(), x.column(1).to_pylist(), strict=True):
            a, b = find(a), find(b)
            if a < b:
                root[b] = a
            elif b < a:
                root[a] = b
            else:
                root.setdefault(a, a)
    nodes = [n for n in root if root[n] != n]
    tops = {find(n) for n in nodes}
    nodes += tops | (root.keys() - set(nodes)) if roots else root.keys() - tops - set(nodes)
    for i in range(0, len(nodes), 1 << 16):
        part = nodes[i : i + (1 << 16)]
        yield pa.record_batch([pa.array([find(n) for n in part], kind.field(0).type), pa.array(part, kind.field(1).type)], schema=kind)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of edges (a, b), any order, repeats and self-links allowed; component is
    the smallest node that can be reached. Each partition first contracts its own links, then so do tasks that take
    several partitions, up to a bounded number of links each; then large-star and
    small-star steps alternate, so a round halves long paths and no node's neighbours are ever gathered in a task:
    each step is a min aggregate, written, and a join back, which Spark splits when one node has most of the links. Links
    with a null end are ignored."""
    e = edges.where("a is not null and b is not null").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    kind = ", ".join(f"{n} {t}" for n, t in e.dtypes)
    e = materialize(e.mapInArrow(_forest, kind), "cc")
    tasks = -(-e.count() // LINKS)
    if tasks <= 1:  # a task's own bound
        found = materialize(e.coalesce(1).mapInArrow(lambda it: _forest(it, True), kind).select(F.col("b").alias("node"), F.col("a").alias("component")), "cc-found")
        discard(e)
        return found
    nxt = materialize(e.coalesce(tasks).mapInArrow(_forest, kind), "cc")
    discard(e)
    e = nxt
    for r in range(max_rounds + 1):
        # done when every larger end has one smaller end, which is nobody's larger end
        links = e.where("a < b")
        roles = links.select(F.col("b").alias("u"), "a", F.lit(0).alias("n")).unionByName(links.select(F.col("a").alias("u"), F.lit(None).cast(e.schema["a"].dataType).alias("a"), F.lit(1).alias("n")))
        roles = roles.groupBy("u").agg(F.min("a").alias("lo"), F.max("a").alias("hi"), F.max("n").alias("n"))
        if not roles.where("lo != hi or lo is not null and n = 1").limit(1).count():
            break
        if r == max_rounds:
            raise RuntimeError(f"components: not stable after {max_rounds} rounds")
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).toDF("u", "v")
        least, _ = counted(both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("m")).coalesce(tasks), "cc-least")
        large = materialize(both.where("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct().coalesce(tasks), "cc-large")
        small, _ = counted(large.groupBy(F.col("b").alias("u")).agg(F.min("a").alias("m")).coalesce(tasks), "cc-small")
        down = large.select(F.col("b").alias("u"), "a").join(small, "u")
        nxt = down.select(F.col("m").alias("a"), F.explode(F.array("a", "u")).alias("b")).where("a < b").unionByName(e.where("a = b")).distinct()
        nxt = materialize(nxt.coalesce(tasks).mapInArrow(_forest, kind), "cc")
        discard(e, least, large, small)
        e = nxt
    found = e.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(e.select(F.col("a").alias("node"), F.col("a").alias("component")))
    found = materialize(found.groupBy("node").agg(F.min("component").alias("component")).coalesce(tasks), "cc-found")
    discard(e)
    return found
