"""Mixing sources to target weights by Pfair scheduling: every block of a source has a release time and a deadline
from the source's weight, and earliest-deadline-first fills the slots, so at any slot a source is less than one block
away from its share.

A source's k-th block is released at slot floor((k - 1) / w) and due by slot ceil(k / w), w being its exact weight
among the sources left. The schedule repeats where the weights are small whole numbers to each other; else it is made
block by block, in one task that holds one entry for each source and sends its rows on as it goes (blocks, not rows).
When a source runs out, the next phase starts with the weights of the sources left; every row is placed. Rows are dealt
to blocks by an order that depends on a hash of their id: ranks are counted within (source, hash bucket), buckets
hold a bounded number of rows on average, and sums over buckets, and over runs of buckets, give the rest. Blocks hold
BLOCK_ROWS rows, or a power of two times as many where there would be more than MAX_BLOCKS of them, so the one task
has a bounded number of turns to make."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from fractions import Fraction
from math import gcd, lcm

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from claimlens.llm.common import documents
from claimlens.session import counted, materialize

BLOCK_ROWS = 64
MAX_BLOCKS = 1 << 22
#: Rows that a bucket of the order holds on average, over all sources.
BUCKET_ROWS = 1_024
#: Buckets in a run, whose sizes are summed up in one task.
RUN = 1 << 10
TEMPERATURE = 0.5


def _name(source: str | None) -> str:
    return "0" if source is None else f"1{source}"


def quanta(weights: dict) -> dict:
    """The smallest whole numbers that are to each other as the weights, a float counting as the decimal it is written as."""
    exact = {k: Fraction(w) if isinstance(w, (int, Fraction)) else Fraction(str(float(w))) for k, w in weights.items()}
    common = lcm(*(x.denominator for x in exact.values()))
    whole = {k: int(x * common) for k, x in exact.items()}
    least = gcd(*whole.values())
    return {k: x // least for k, x in whole.items()}


def period(shares: dict) -> Iterator[tuple[object, int, int, int]]:
    """One period as (source, k, release, deadline) by slot: at each slot the released block with the earliest
    deadline; ties go to the block whose window overlaps the next one of its source, then to the larger weight."""
    total = sum(shares.values())

    def window(k: int, a: int) -> tuple[int, int]:
        return (k - 1) * total // a, -(-k * total // a)

    coming = [(0, _name(s), s, 1) for s in shares]
    heapq.heapify(coming)
    ready, slot = [], 0
    while slot < total:
        while coming and coming[0][0] <= slot:
            release, name, s, k = heapq.heappop(coming)
            due = window(k, shares[s])[1]
            heapq.heappush(ready, (due, -(k * total % shares[s] != 0), -shares[s], name, s, k, release))
        due, _, _, name, s, k, release = heapq.heappop(ready)
        yield s, k, release, due
        slot += 1
        if k < shares[s]:
            heapq.heappush(coming, (window(k + 1, shares[s])[0], name, s, k + 1))


def plan(blocks: dict, weights: dict) -> Iterator[tuple]:
    """(source, phase, first block, last block, share, period length, rank within the period's blocks, slot, start,
    release, deadline) for each block of each phase's period: a phase runs whole periods while all its sources last,
    then as much of one as there is until a source runs out, whose blocks stand alone."""
    left = {s: n for s, n in blocks.items() if n}
    done = dict.fromkeys(left, 0)
    start, phase = 0, 0
    while left:
        shares = quanta({s: weights[s] for s in left})
        total = sum(shares.values())
        whole = min(left[s] // a for s, a in shares.items())
        if whole:
            for slot, (s, k, release, due) in enumerate(period(shares)):
                yield s, phase, done[s], done[s] + whole * shares[s], shares[s], total, k - 1, slot, start, release, due
            start += whole * total
            phase += 1
            for s, a in shares.items():
                done[s] += whole * a
                left[s] -= whole * a
        if all(left.values()):
            placed = dict.fromkeys(left, 0)
            for s, k, release, due in period(shares):
                yield s, phase, done[s] + k - 1, done[s] + k, 1, 1, 0, 0, start, release, due
                start += 1
                placed[s] = k
                if k == left[s]:
                    break
            phase += 1
            for s, n in placed.items():
                done[s] += n
                left[s] -= n
        left = {s: n for s, n in left.items() if n}


TURNS = pa.schema([("s_", pa.string()), ("b_", pa.int64()), ("slot", pa.int64()), ("release", pa.int32()), ("deadline", pa.int32()), ("phase", pa.int32())])
TURNS_SQL = "s_ string, b_ long, slot long, release int, deadline int, phase int"
#: Turns that are sent on at once.
TURN_ROWS = 1 << 16
#: A light source's first deadline may lie further off than a column of the contract's type reaches.
LAST = (1 << 31) - 1


def block_size(rows: int, least: int = BLOCK_ROWS, most_blocks: int = MAX_BLOCKS) -> int:
    while rows > least * most_blocks:
        least *= 2
    return least


def target_weights(counts: dict, weights: dict | None, temperature: float) -> dict:
    """The weight of each source of counts (source: rows): as given, else rows to the power of temperature, scaled to the
    smallest given one."""
    own = {s: float(Fraction(n)) ** temperature for s, n in counts.items()}
    if not weights:
        return own
    named = min((w for s, w in weights.items() if s in counts), default=1.0)
    least = min((own[s] for s in counts if s not in weights), default=1.0)
    return {s: weights.get(s, own[s] / least * named) for s in counts}


def _turns(batches, weights: dict | None, temperature: float, block_rows: int) -> Iterator[pa.RecordBatch]:
    """A row for each block of the sources (source, rows) of all batches."""
    counts = {s: n for x in batches for s, n in zip(x.column(0).to_pylist(), x.column(1).to_pylist(), strict=True)}
    counts = {s: counts[s] for s in sorted(counts, key=_name)}
    blocks = {s: -(-n // block_rows) for s, n in counts.items()}
    rows: list[tuple] = []

    def sent():
        return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), TURNS, strict=True)], schema=TURNS)

    for s, phase, lo, hi, share, length, k, turn, start, release, due in plan(blocks, target_weights(counts, weights, temperature)):
        for i, block in enumerate(range(lo + k, hi, share)):
            rows.append((s, block, start + i * length + turn, min(release, LAST), min(due, LAST), phase))
            if len(rows) == TURN_ROWS:
                yield sent()
                rows = []
    if rows:
        yield sent()


def schedule(docs: DataFrame, weights: dict | None = None, doc_id: str = "doc_id", source: str = "source", block_rows: int | None = None, temperature: float = TEMPERATURE) -> DataFrame:
    """doc_id, source, block (of its source), place (in the block), slot, position, release, deadline and phase of every row.
    slot is the block's turn; position = slot * block_rows + place orders the mixed stream. Times count from the phase's
    period. weights: positive target weights by source; by default the number of rows to the power of temperature, which
    also stands in for sources it doesn't name, scaled to the smallest of them. block_rows: see block_size. A null source
    is a source of its own. Rows that repeat an id have places of their own. Other columns aren't read."""
    if min((weights or {None: 1}).values(), default=1) <= 0:
        raise ValueError("weights must be positive")
    order = F.xxhash64(F.lit(5), "doc_id")
    rows = materialize(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source")).withColumn("o", order), "mix-rows")
    total = rows.count()
    block_rows = block_rows or block_size(total)
    buckets = max(1, -(-total // BUCKET_ROWS))
    rows = rows.withColumn("bucket", F.pmod(F.shiftright("o", 3), F.lit(buckets)))
    sizes = materialize(rows.groupBy("source", "bucket").agg(F.count("*").alias("n")), "mix-sizes")
    # one row for each source
    counts = sizes.groupBy("source").agg(F.sum("n").alias("n"))
    turns, _ = counted(counts.coalesce(1).mapInArrow(lambda it: _turns(it, weights, temperature, block_rows), TURNS_SQL), "mix-turns")

    def before(*keys: str):
        return F.coalesce(F.sum("n").over(Window.partitionBy("source", *keys).orderBy("run" if not keys else "bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    sizes = sizes.withColumn("run", F.floor(F.col("bucket") / RUN))
    runs = sizes.groupBy("source", "run").agg(F.sum("n").alias("n")).select(F.col("source").alias("s_"), F.col("run").alias("r_"), before().alias("earlier"))
    sizes = sizes.withColumn("within", before("run")).join(runs, F.col("source").eqNullSafe(F.col("s_")) & (F.col("run") == F.col("r_")))
    sizes, _ = counted(sizes.select(F.col("source").alias("s_"), F.col("bucket").alias("b_"), (F.col("within") + F.col("earlier")).alias("before")), "mix-before")
    ranked = rows.withColumn("r", F.row_number().over(Window.partitionBy("source", "bucket").orderBy("o", "doc_id")) - 1)
    ranked = ranked.join(sizes, F.col("source").eqNullSafe(F.col("s_")) & (F.col("bucket") == F.col("b_")))
    rank = F.col("r") + F.col("before")
    ranked = ranked.select("doc_id", "source", F.floor(rank / block_rows).alias("block"), (rank % block_rows).cast("int").alias("place"))
    placed = ranked.join(turns, F.col("source").eqNullSafe(F.col("s_")) & (F.col("block") == F.col("b_")))
    return placed.select("doc_id", "source", "block", "place", "slot", (F.col("slot") * block_rows + F.col("place")).alias("position"), "release", "deadline", "phase")


def mixed(docs: DataFrame, weights: dict | None = None, doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    """All rows of docs in the order of the mix: files and rows within files follow it. Columns stay as they are. Rows that
    repeat an id share its first position."""
    placed = schedule(docs, weights, doc_id, source).groupBy(F.col("doc_id").alias("__id")).agg(F.min("position").alias("__position"))
    placed, _ = counted(placed, "mix-positions")
    both = docs.join(placed, docs[doc_id].eqNullSafe(placed["__id"]))
    return both.repartitionByRange(placed["__position"]).sortWithinPartitions(placed["__position"]).select(docs["*"])


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schedule(documents(spark, sf_dir).select("doc_id", "source"))
