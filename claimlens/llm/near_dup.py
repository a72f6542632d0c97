"""N-gram Jaccard join: near-duplicate documents by a blocked sparse product of the document by shingle incidence.

Columns (shingle hashes) are dealt into blocks by hash range; each block is multiplied on its own and the partial
results are summed by document or pair. Bounds that follow from the sizes alone discard what can't reach the
threshold, so the product is never formed for pairs, only for what the bounds leave:

1. Equal sets collapse into one class, the smallest doc_id standing for it.
2. Two sets A and B that link share at least min(kA, kB) of their first floor(n/4) + k hashes in any global order
   (k(n) = ceil(n/8), sizes within 3:4, hash order). A first product over these prefixes counts for each class how
   many of its prefix hashes any other class has; below ceil(3n/32) it can't link. Blocks see a hash at most once
   per group of texts, since equal hashes of a group are merged before the shuffle.
3. For the classes left, a second product over whole sets gives each hash's document frequency. A class whose
   hashes of frequency 1 fill its prefix of floor(n/4) + 1, rarest first, can't link. The others keep their shared
   hashes, rarest first.
4. Classes with a common prefix hash are candidates, if the hash's places among those of both (rarest first) leave
   room for the overlap that a link needs. Rounds over all tasks compare the members of a block (the classes with one
   prefix hash) with a few of them, its pivots, which then leave it; linked classes are joined into components, and
   blocks whose members are all in one component need no further pair. So a block of n near copies takes about n
   comparisons, every pair that could link two components is compared, and no block is ever gathered in a task.

Set elements are 64-bit hashes of five lower-cased words; an error needs two unequal shingles of the same two
texts to collide (below n*n / 2**64 for texts of n shingles)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimlens.llm.common import documents, given_back
from claimlens.llm.textcols import mix, shingle_sets
from claimlens.operators.graph import components
from claimlens.session import counted, discard, limited, materialize, partitions, sweep

#: Entries that a task holds before it sends them to their blocks.
GROUP = 600_000
#: Blocks of columns for each shuffle partition; more blocks spread evener and need less memory each.
BLOCKS = 2
#: What a round after the second may do, if more than one pivot of each block leaves it room: tries, of which the sizes
#: and places of most leave no overlap to count, and pairs that are compared (as many as the last round's tries let
#: expect). Both grow with the classes.
TRIES, TRIES_PER_CLASS = 20_000_000, 64
PAIRS, PAIRS_PER_CLASS = 200_000, 2
#: Pivots of a block in a round, which go to its members as an array: in the first, in the second, and at most.
FEW_PIVOTS = (1, 6)
MAX_PIVOTS = 1024

BLOB = pa.schema([("block", pa.int32()), ("kind", pa.int8()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary()), ("d", pa.binary())])
BLOB_SQL = "block int, kind byte, a binary, b binary, c binary, d binary"
U = np.uint64


def _blobs(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(rows), 64):
        part = rows[i : i + 64]
        yield pa.record_batch([pa.array(list(x), f.type) for x, f in zip(zip(*part, strict=True), BLOB, strict=True)], schema=BLOB)


def _class(s: np.ndarray) -> tuple[int, int]:
    """The two halves of a set's digest; the first names its class."""
    digest = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
    return int.from_bytes(digest[:8], "little") | 1, int.from_bytes(digest[8:], "little")


def _signed(d1: int) -> int:
    return d1 - (1 << 64) if d1 >> 63 else d1


def _by_block(h: np.ndarray, width: int) -> Iterator[tuple[int, int, int]]:
    """Blocks of sorted hashes: number, from, to. width: the hashes that a block spans."""
    if not len(h):
        return
    n = (1 << 64) // width + 1
    edges = np.searchsorted(h, np.array([min(i * width, (1 << 64) - 1) for i in range(n + 1)], np.uint64))
    edges[-1] = len(h)
    for i in np.flatnonzero(np.diff(edges)).tolist():
        yield i, int(edges[i]), int(edges[i + 1])


def _task() -> int:
    """The number of the task, so that what belongs to no block is dealt evenly."""
    context = TaskContext.get()
    return context.partitionId() if context else 0


def _prefix_blobs(batches, width: int):
    """kind 0: sorted hashes of a block within its range (uint32 of the high bits) and the class of each, 0 for
    several classes; kind 1: classes and how many hashes each shares within the group; kind 2: doc_id, class, n."""
    shift = max(0, (width - 1).bit_length() - 32)
    hs, ds, rows, waiting, sent = [], [], [], 0, _task()

    def flush():
        nonlocal hs, ds, rows, waiting, sent
        out = []
        if rows:
            ids, d1, d2, n = (np.array(x, t) for x, t in zip(zip(*rows, strict=True), (np.int64, np.uint64, np.uint64, np.int64), strict=True))
            out.append((-1 - sent, 2, ids.tobytes(), d1.tobytes(), d2.tobytes(), n.tobytes()))
        if hs:
            h, d = np.concatenate(hs), np.concatenate(ds)
            order = np.argsort(h, kind="stable")
            h, d = h[order], d[order]
            first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
            last = np.append(first[1:], len(h)) - 1
            several = np.repeat((np.minimum.reduceat(d, first) != np.maximum.reduceat(d, first)), last - first + 1)
            who, count = np.unique(d[several], return_counts=True)
            if len(who):
                out.append((-1 - sent, 1, who.tobytes(), count.astype(np.int64).tobytes(), b"", b""))
            h, d = h[first], np.where(several[first], U(0), d[first])
            for i, a, b in _by_block(h, width):
                out.append((i, 0, ((h[a:b] - U(i * width)) >> U(shift)).astype(np.uint32).tobytes(), d[a:b].tobytes(), b"", b""))
        hs, ds, rows, waiting, sent = [], [], [], 0, sent + 13
        yield from _blobs(out)

    seen: set[int] = set()
    for x in batches:
        for doc_id, s in zip(x.column(0).to_pylist(), shingle_sets(x.column(1)), strict=True):
            n = len(s)
            if doc_id is None:
                continue
            if not n:
                rows.append((doc_id, 0, 0, 0))
                continue
            d1, d2 = _class(s)
            rows.append((doc_id, d1, d2, n))
            if d1 not in seen:
                seen.add(d1)
                p = n // 4 + -(-n // 8)
                hs.append(s[:p])
                ds.append(np.full(min(p, n), d1, np.uint64))
                waiting += min(p, n)
            if waiting >= GROUP or len(rows) >= 50_000:
                yield from flush()
                seen.clear()
    yield from flush()


def _blocks(batches) -> Iterator[tuple[int, list]]:
    """(block, its blobs) from a partition that is sorted by block."""
    block, held = None, []
    for x in batches:
        for row in zip(*(c.to_pylist() for c in x.columns), strict=True):
            if row[0] != block:
                if held:
                    yield block, held
                block, held = row[0], []
            held.append(row)
    if held:
        yield block, held


COUNTS = pa.schema([("kind", pa.int8()), ("doc_id", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("n", pa.int64())])


def _count_batch(kind: int, doc, d1, d2, n) -> pa.RecordBatch:
    size = len(d1)
    zero = np.zeros(size, np.int64)
    cols = [np.full(size, kind, np.int8)] + [zero if c is None else c.view(np.int64) if c.dtype == np.uint64 else c for c in (doc, d1, d2, n)]
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(cols, COUNTS, strict=True)], schema=COUNTS)


def _shared_counts(batches):
    """Products of the blocks, summed over columns: kind 1 rows have a class and how many of its hashes here are in
    another class too; kind 2 rows are the documents."""
    for _, rows in _blocks(batches):
        entries = [r for r in rows if r[1] == 0]
        for r in rows:
            if r[1] == 1:
                yield _count_batch(1, None, np.frombuffer(r[2], np.uint64), None, np.frombuffer(r[3], np.int64))
            elif r[1] == 2:
                yield _count_batch(2, np.frombuffer(r[2], np.int64), np.frombuffer(r[3], np.uint64), np.frombuffer(r[4], np.uint64), np.frombuffer(r[5], np.int64))
        if not entries:
            continue
        h = np.concatenate([np.frombuffer(r[2], np.uint32) for r in entries])
        d = np.concatenate([np.frombuffer(r[3], np.uint64) for r in entries])
        order = np.argsort(h, kind="stable")
        h, d = h[order], d[order]
        first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        runs = np.diff(np.append(first, len(h)))
        several = np.repeat((np.minimum.reduceat(d, first) != np.maximum.reduceat(d, first)), runs) & (d != 0)
        who, count = np.unique(d[several], return_counts=True)
        if len(who):
            yield _count_batch(1, None, who, None, count.astype(np.int64))


def _set_blobs(batches, width: int):
    """Whole sets of (doc_id, text, class): kind 0 has sorted hashes of a block and the class of each, kind 1 classes and
    their set sizes. A row whose set is of another class than asked for is left out, and a class that several rows have
    is sent once."""
    hs, ids, waiting, sent = [], [], 0, _task()
    seen: set[int] = set()

    def flush():
        nonlocal hs, ids, waiting, sent
        if hs:
            h, n = np.concatenate(hs), np.array([len(x) for x in hs], np.int64)
            reps = np.array(ids, np.int64)
            d = np.repeat(reps, n)
            order = np.argsort(h, kind="stable")
            h, d = h[order], d[order]
            yield from _blobs([(-1 - sent, 1, reps.tobytes(), n.tobytes(), b"", b""), *((i, 0, h[a:b].tobytes(), d[a:b].tobytes(), b"", b"") for i, a, b in _by_block(h, width))])
        hs, ids, waiting, sent = [], [], 0, sent + 13

    for x in batches:
        for asked, s in zip(x.column(2).to_pylist(), shingle_sets(x.column(1)), strict=True):
            if asked in seen or not len(s) or _signed(_class(s)[0]) != asked:
                continue
            seen.add(asked)
            hs.append(s)
            ids.append(asked)
            waiting += len(s)
            if waiting >= GROUP:
                yield from flush()
    yield from flush()


def _to_owners(kind: int, owners: np.ndarray, columns: list[np.ndarray], buckets: int) -> Iterator[pa.RecordBatch]:
    """Rows of arrays, dealt to buckets of the documents they belong to."""
    if not len(owners):
        return
    to = (mix(owners.astype(np.uint64)) % U(buckets)).astype(np.int64)
    order = np.argsort(to, kind="stable")
    to = to[order]
    first = np.flatnonzero(np.concatenate(([True], to[1:] != to[:-1])))
    last = np.append(first[1:], len(to))
    columns = [c[order] for c in (owners, *columns)]
    empty = [b""] * (4 - len(columns))
    yield from _blobs([(int(to[i]), kind, *(c[i:j].tobytes() for c in columns), *empty) for i, j in zip(first.tolist(), last.tolist(), strict=True)])


def _frequencies(batches, buckets: int):
    """The hashes of a block that several classes have, with the number of those classes, sent to them (kind 0); set
    sizes are passed on to theirs (kind 1). A class that came from several tasks counts once."""
    for _, rows in _blocks(batches):
        for r in rows:
            if r[1] == 1:
                yield from _to_owners(1, np.frombuffer(r[2], np.int64), [np.frombuffer(r[3], np.int64)], buckets)
        rows = [r for r in rows if r[1] == 0]
        if not rows:
            continue
        h = np.concatenate([np.frombuffer(r[2], np.uint64) for r in rows])
        d = np.concatenate([np.frombuffer(r[3], np.int64) for r in rows])
        order = np.lexsort((d, h))
        h, d = h[order], d[order]
        once = np.concatenate(([True], (h[1:] != h[:-1]) | (d[1:] != d[:-1])))
        h, d = h[once], d[once]
        first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        runs = np.diff(np.append(first, len(h)))
        df = np.repeat(runs, runs)
        several = df > 1
        yield from _to_owners(0, d[several], [h[several], df[several].astype(np.int32)], buckets)


ROWS = pa.schema([("rep", pa.int64()), ("n", pa.int64()), ("h", pa.binary()), ("prefix", pa.list_(pa.int64()))])


def _ordered(batches):
    """Shared hashes of each class, sorted for the exact overlap, and those of its prefix, rarest first."""
    for _, rows in _blocks(batches):
        sizes: dict[int, int] = {}
        for r in rows:
            if r[1] == 1:
                sizes.update(zip(np.frombuffer(r[2], np.int64).tolist(), np.frombuffer(r[3], np.int64).tolist(), strict=True))
        rows = [r for r in rows if r[1] == 0]
        if not rows:
            continue
        d, h, df = (np.concatenate([np.frombuffer(r[i], t) for r in rows]) for i, t in ((2, np.int64), (3, np.uint64), (4, np.int32)))
        order = np.lexsort((h, d))
        d, h, df = d[order], h[order], df[order]
        first = np.flatnonzero(np.concatenate(([True], d[1:] != d[:-1])))
        out = []
        for a, b in zip(first.tolist(), np.append(first[1:], len(d)).tolist(), strict=True):
            n = sizes[int(d[a])]
            most = n // 4 + 1 - (n - (b - a))
            if most > 0:
                rare = np.argsort(df[a:b], kind="stable")[:most]
                out.append((int(d[a]), n, h[a:b].tobytes(), h[a:b][rare].view(np.int64)))
            if len(out) == 1024 or out and b == len(d):
                yield pa.record_batch([pa.array(list(c), f.type) for c, f in zip(zip(*out, strict=True), ROWS, strict=True)], schema=ROWS)
                out = []


LINKS_SQL = "a long, b long, la long, lb long"


def _overlaps(batches):
    """Pairs whose exact overlap reaches the threshold, with their labels."""
    for x in batches:
        *pair, na, nb, ha, hb = x.columns
        keep = []
        for i, (m, n, p, q) in enumerate(zip(na.to_pylist(), nb.to_pylist(), ha, hb, strict=True)):
            p, q = np.frombuffer(p.as_buffer(), np.uint64), np.frombuffer(q.as_buffer(), np.uint64)
            both = np.sort(np.concatenate((p, q)))
            o = int((both[1:] == both[:-1]).sum())
            if 100 * o >= 75 * (m + n - o):
                keep.append(i)
        keep = pa.array(keep, pa.int64())
        yield pa.record_batch([c.take(keep) for c in pair], names=["a", "b", "la", "lb"])


#: Bytes of all sets' shared hashes up to which they are broadcast.
BROADCAST_BYTES = 16_000_000


def _verified(pairs: DataFrame, sets: DataFrame, small: bool, n: int) -> DataFrame:
    """Those of n pairs (a, b, la, lb) that link. Each pair carries the hashes of its b to those of its a, unless the sets are
    small enough to be everywhere."""
    sets = F.broadcast(sets) if small else sets.hint("merge")
    right = sets.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("h").alias("hb"))
    left = sets.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("h").alias("ha"))
    both = pairs.join(right, "b").join(left, "a").select("a", "b", "la", "lb", "na", "nb", "ha", "hb")
    return _in_tasks(both, n, TASK_PAIRS).mapInArrow(lambda it: given_back(_overlaps(it)), LINKS_SQL)


def _dealt(blobs: DataFrame) -> DataFrame:
    """blobs with each block in the partition of its number, so that all partitions have as many, sorted by block."""
    parts = partitions(blobs.sparkSession)
    return blobs.repartitionById(parts, F.pmod("block", F.lit(parts)).cast("int")).sortWithinPartitions("block")


def _width(spark: SparkSession) -> int:
    return -(-(1 << 64) // max(1, partitions(spark) * BLOCKS))


def links(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", pairs: int = PAIRS) -> tuple[DataFrame, DataFrame]:
    """(classes, edges). classes: a row for each row of docs with doc_id, n_shingles, rep (the smallest doc_id with the
    same set; itself without words) and class (of its set; null without words). edges (a, b): pairs of classes that
    link, enough of them that rows have a path of edges and common classes exactly if they have a path of links. Rows
    that repeat a doc_id count by their own texts. Null text is empty; rows without doc_id are left out; other
    columns aren't read, so their names don't matter."""
    spark = docs.sparkSession
    width, parts = _width(spark), partitions(spark)
    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))

    dealt = base.mapInArrow(lambda it: given_back(_prefix_blobs(it, width)), BLOB_SQL)
    counts = dealt.transform(_dealt).mapInArrow(lambda it: given_back(_shared_counts(it)), "kind byte, doc_id long, d1 long, d2 long, n long")
    counts = materialize(counts, "near-counts")
    rows = counts.where("kind = 2")
    # written first, so that the join back has a shuffle of its own, which Spark can split where one set has many copies
    reps, _ = counted(rows.where("n > 0").groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n")), "near-reps")
    shared = counts.where("kind = 1").groupBy("d1").agg(F.sum("n").alias("shared"))
    left, _ = counted(reps.join(shared, "d1").where("32 * shared >= 3 * n").select(F.col("rep").alias("doc_id"), F.col("d1").alias("class")), "near-left")
    classes = rows.where("n > 0").join(reps.drop("n"), ["d1", "d2"]).select("doc_id", F.col("n").alias("n_shingles"), "rep", F.col("d1").alias("class"))
    classes = materialize(classes.unionByName(rows.where("n = 0").select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("rep"), F.lit(None).cast("long").alias("class"))), "near-classes")
    del dealt, rows, shared
    discard(counts, reps)
    sweep(spark)

    # from here on a class goes by its own number, as an id may stand on rows of several classes
    chosen = base.join(left, "doc_id").select("doc_id", "text", "class")
    buckets = parts
    freq = chosen.mapInArrow(lambda it: given_back(_set_blobs(it, width)), BLOB_SQL).transform(_dealt).mapInArrow(lambda it: given_back(_frequencies(it, buckets)), BLOB_SQL)
    owned = freq.transform(_dealt).mapInArrow(lambda it: given_back(_ordered(it)), "rep long, n long, h binary, prefix array<long>")
    sets = materialize(owned, "near-sets")
    del chosen, freq, owned
    discard(left)
    sweep(spark)
    edges = _linked(sets, pairs)
    discard(sets)
    return classes, edges


#: Rows, and pairs to be compared, for each task of a round. Late rounds have few rows, and many tasks of a few rows each
#: take longer than their work.
TASK_ROWS, TASK_PAIRS = 20_000, 500


def _in_tasks(df: DataFrame, rows: int, each: int = TASK_ROWS) -> DataFrame:
    """df, which has up to about so many rows, in no more tasks than these are worth."""
    return df.coalesce(max(1, min(partitions(df.sparkSession), -(-rows // each))))


def _linked(sets: DataFrame, most_pairs: int) -> DataFrame:
    """Edges (a, b) between sets (rep, n, h, prefix) that link, enough of them to connect each component of links. Two sets of
    n and m hashes whose places of a common hash are p and q can link only if the hashes from there on hold the overlap, at
    least 3/7 of n + m, where no common hash stands before; and if their sizes are within 3:4."""
    n_sets, size, n = sets.agg(F.count("*"), F.coalesce(F.sum(F.length("h")), F.lit(0)), F.coalesce(F.sum(F.size("prefix")), F.lit(0))).first()
    small = size <= BROADCAST_BYTES
    entries = sets.select("rep", "n", (F.col("n") - F.length("h") / 8).cast("long").alias("skipped"), F.posexplode("prefix").alias("at", "h"))
    # a link's smaller set has their first common hash within its first seventh, so a block needs such a member
    mine = materialize(_in_tasks(entries.select("h", "rep", "n", (F.col("skipped") + F.col("at")).alias("p"), F.col("rep").alias("label")), n), "near-entries")
    edges = sets.select(F.col("rep").alias("a"), F.col("rep").alias("b")).where("false")
    share = 1.0
    early = F.when(F.expr("7 * p <= n"), F.col("n"))
    for r in count():
        parts = mine.select("h", "label", F.lit(1).cast("long").alias("m"), early.alias("least"), early.alias("most"))  # each a component of its own
        if r:
            parts = parts.groupBy("h", "label").agg(F.sum("m").alias("m"), F.min("least").alias("least"), F.max("most").alias("most"))
        blocks = parts.groupBy("h").agg(F.count("*").alias("labels"), F.sum("m").alias("m"), F.max(F.struct("m", "label")).alias("major"), F.min("least").alias("least"), F.max("most").alias("most"))
        # a pair of two components has a member outside the largest one of the block
        blocks = blocks.where("labels > 1 and least is not null").select("h", "least", "most", F.col("major.label").alias("major"), (F.col("m") - F.col("major.m")).alias("minor"))
        blocks, n_blocks = counted(_in_tasks(blocks, n), "near-blocks")
        if not n_blocks:
            break
        # what is smaller than all that may be the smaller one of a link, or too large for them, is out
        open_ = materialize(_in_tasks(mine.join(blocks, "h").where("n >= least and 3 * n <= 4 * most").drop("least", "most"), n), "near-open")
        n = left = max(1, open_.count())
        if r < len(FEW_PIVOTS):
            many = FEW_PIVOTS[r]
            able, bucket, closed = F.expr("7 * p <= n"), F.pmod(F.xxhash64(F.lit(-r), "rep"), F.lit(many)), F.lit(False)
        else:
            most = min(max(TRIES, TRIES_PER_CLASS * n_sets), max(most_pairs, PAIRS_PER_CLASS * n_sets) / share)
            many = max(1, min(MAX_PIVOTS, int(most / left)))
            able, closed = F.col("label") != F.col("major"), F.col("minor") <= many
            bucket = F.when(closed, F.col("rep")).otherwise(F.pmod(F.xxhash64(F.lit(-r), "rep"), F.lit(many)))
        # of the first round the smallest members, which most others can link to; later any
        order = F.struct(F.col("n") if r == 0 else F.lit(0), F.xxhash64(F.lit(r), "h", "rep"))
        pivots = open_.where(able).groupBy("h", bucket.alias("s")).agg(F.min_by(F.struct("rep", "n", "p", "label"), order).alias("pivot"))
        pivots = materialize(_in_tasks(pivots.groupBy("h").agg(F.collect_list("pivot").alias("pivots")), n), "near-pivots")
        pivots = limited(pivots, pivots.agg(F.sum(F.size("pivots"))).first()[0] or 0)
        both = open_.join(pivots, "h")
        can = F.expr("filter(pivots, x -> x.label != label and 4 * n >= 3 * x.n and 4 * x.n >= 3 * n and 7 * least(n - p, x.n - x.p) >= 3 * (n + x.n))")
        pairs = both.select("rep", "label", F.explode(can).alias("x")).select(F.col("rep").alias("a"), F.col("x.rep").alias("b"), F.col("label").alias("la"), F.col("x.label").alias("lb"))
        turned = F.when(F.col("a") < F.col("b"), F.struct("a", "b", "la", "lb")).otherwise(F.struct(F.col("b").alias("a"), F.col("a").alias("b"), F.col("lb").alias("la"), F.col("la").alias("lb")))
        pairs = materialize(_in_tasks(pairs.select(turned.alias("x")).distinct().select("x.*"), n), "near-pairs")
        n_pairs = pairs.count()
        share = max(1.0, n_pairs) / (left * many)
        # a pivot has met all others of its block; a block whose smaller components have all been pivots is done
        rest = both.where(~closed & ~F.array_contains(F.transform("pivots", lambda x: x["rep"]), F.col("rep"))).select("h", "rep", "n", "p", "label")
        gone = [mine, blocks, open_, pivots, pairs]
        if n_pairs:
            found = materialize(_verified(pairs, sets, small, n_pairs), "near-links")
            edges = edges.unionByName(found.select("a", "b"))
            if found.limit(1).count():
                merged, _ = counted(components(found.select(F.col("la").alias("a"), F.col("lb").alias("b"))).withColumnRenamed("node", "label"), "near-labels")
                rest = rest.join(merged, "label", "left").select("h", "rep", "n", "p", F.coalesce("component", "label").alias("label"))
                gone.append(merged)
        mine = materialize(_in_tasks(rest, n), "near-entries")
        discard(*gone)
        sweep(sets.sparkSession)
    edges = materialize(_in_tasks(edges, edges.count()), "near-edges")
    discard(mine)
    return edges


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", pairs: int = PAIRS) -> DataFrame:
    """doc_id, n_shingles (size of the set of 5-word shingles), rep (smallest doc_id with the same set) and
    component_id (smallest doc_id reachable by links of Jaccard similarity 0.75 or more, itself included) of every
    document. Texts without words, empty and null ones link with nothing."""
    classes, edges = links(docs, doc_id, text, pairs)
    return _labelled(classes, edges).drop("class")


def _labelled(classes: DataFrame, edges: DataFrame) -> DataFrame:
    found = components(edges).withColumnRenamed("node", "class")
    reps = found.join(classes.groupBy("class").agg(F.min("rep").alias("rep")), "class")
    least, _ = counted(reps.groupBy("component").agg(F.min("rep").alias("component_id")), "near-least")
    named, _ = counted(found.join(least, "component").select("class", "component_id"), "near-named")
    discard(found, least)
    return classes.join(named, "class", "left").select("doc_id", "n_shingles", "rep", F.coalesce("component_id", "rep").alias("component_id"), "class")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the rows of which a near duplicate (or a copy) has a smaller id; columns and their order stay.
    Rows without an id stay, and so do all rows of an id that repeats with its smallest. An id on rows of several texts
    loses those only that have a near duplicate."""
    classes, edges = links(docs, doc_id, text)
    found = _labelled(classes, edges).select(F.col("doc_id").alias("__gone"), "class", (F.col("doc_id") != F.col("component_id")).alias("gone"))
    found = materialize(found, "near-found")
    gone, _ = counted(found.where("gone").select("__gone").distinct(), "near-gone")
    mixed, n = counted(found.groupBy("__gone").agg(F.min("gone").alias("lo"), F.max("gone").alias("hi")).where("lo != hi").select("__gone"), "near-mixed-ids")
    kept = docs.join(gone, docs[doc_id].cast("long") == gone["__gone"], "left_anti")
    if not n:
        return kept
    # ids with rows that stay and rows that go: the latter by their class
    rows = docs.join(mixed, docs[doc_id].cast("long") == mixed["__gone"], "left_semi")
    stay = found.where("not gone").join(mixed, "__gone", "left_semi").select(F.col("__gone").alias("__id"), F.coalesce("class", F.lit(0)).alias("__class")).distinct()
    stay, _ = counted(stay, "near-stay")
    names = F.pandas_udf(_classes_of, "long")
    rows = rows.withColumn("__of", names(rows[text].cast("string")))
    rows = rows.join(stay, (rows[doc_id].cast("long") == stay["__id"]) & (rows["__of"] == stay["__class"]), "left_semi")
    return kept.unionByName(rows.drop("__of"))


def _classes_of(texts: pd.Series) -> pd.Series:
    """The class of each text, 0 without words."""
    sets = shingle_sets(pa.array(texts, pa.string(), from_pandas=True))
    return pd.Series([_signed(_class(s)[0]) if len(s) else 0 for s in sets], dtype="int64")


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")
