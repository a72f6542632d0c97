"""String similarity that Spark has no expression for, in Arrow batches."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimlens.session import limited

#: Longer strings are compared one pair at a time.
SHORT = 64
#: Rows of one name that go together as one list, at most about twice as many.
COPIES = 1000
#: Pairs that a task makes, on average.
PAIRS = 4_000_000


def jaro(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    taken = [False] * len(b)
    hits = []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == c:
                taken[j] = True
                hits.append(c)
                break
    if not hits:
        return 0.0
    other = [b[j] for j in range(len(b)) if taken[j]]
    m, swapped = len(hits), sum(x != y for x, y in zip(hits, other, strict=True))
    return (m / len(a) + m / len(b) + (m - swapped // 2) / m) / 3


def jaro_winkler_py(a: str, b: str, weight: float = 0.1, floor: float = 0.7) -> float:
    """The common prefix counts only for strings above the floor."""
    s = jaro(a, b)
    if s <= floor:
        return s
    prefix = 0
    for x, y in zip(a[:4], b[:4], strict=False):
        if x != y:
            break
        prefix += 1
    return s + prefix * weight * (1 - s)


def _lcs(a: str, b: str) -> int:
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def ratio(a: str, b: str) -> float:
    """100 * 2 * longest common subsequence / length of both."""
    return 100.0 if not a and not b else 200.0 * _lcs(a, b) / (len(a) + len(b))


def token_set_ratio_py(a: str, b: str) -> float:
    """The best ratio of the common words, and the common words with either rest."""
    x, y = set(re.findall(r"\w+", a.lower())), set(re.findall(r"\w+", b.lower()))
    if not x or not y:
        return 0.0
    both = " ".join(sorted(x & y))
    if both and (x <= y or y <= x):
        return 100.0
    left, right = (" ".join(filter(None, (both, " ".join(sorted(s))))) for s in (x - y, y - x))
    return max(ratio(both, left) if both else 0.0, ratio(both, right) if both else 0.0, ratio(left, right))


def _codes(x: pa.Array, pad: int) -> tuple[np.ndarray, np.ndarray]:
    """Code points, a row for each string, filled up with a value (`pad` below the largest) that no text has; lengths."""
    size = pc.utf8_length(x).to_numpy(zero_copy_only=False)
    width = int(size.max())
    if pc.sum(pc.binary_length(x)).as_py() == size.sum():
        ends = np.frombuffer(x.buffers()[1], np.int32)[x.offset : x.offset + len(x) + 1]
        data = np.frombuffer(x.buffers()[2], np.uint8)[ends[0] : ends[-1]] if width else np.zeros(0, np.uint8)
        codes = np.full((len(x), width), 255 - pad, np.uint8)
    else:
        data = np.frombuffer("".join(x.to_pylist()).encode("utf-32-le"), np.uint32)
        codes = np.full((len(x), width), 0xFFFFFFFF - pad, np.uint32)
    codes[np.arange(width) < size[:, None]] = data
    return codes, size


def _jaro_winkler_short(x: pa.Array, y: pa.Array, weight: float = 0.1, floor: float = 0.7) -> np.ndarray:
    """jaro_winkler_py of each pair, a place of either string at a time for all pairs; without nulls."""
    (a, la), (b, lb) = _codes(x, 0), _codes(y, 1)
    at, bt = np.ascontiguousarray(a.T), np.ascontiguousarray(b.T)
    reach = np.maximum(np.maximum(la, lb) // 2 - 1, 0)
    most, one = int(reach.max()), reach.min() == reach.max()
    free, hit = np.ones(bt.shape, bool), np.zeros(at.shape, bool)
    for i in range(len(at)):
        open_ = np.ones(len(x), bool)
        for j in range(max(0, i - most), min(len(bt), i + most + 1)):
            found = at[i] == bt[j]
            found &= free[j]
            found &= open_
            if not one:
                found &= reach >= abs(i - j)
            free[j] ^= found
            open_ ^= found
        hit[i] = ~open_
    hit, taken = np.ascontiguousarray(hit.T), np.ascontiguousarray(~free.T)
    m = hit.sum(1)
    # the matched characters of all pairs, one pair after the other, as many on either side
    wrong = np.concatenate([[0], np.cumsum(a[hit] != b[taken])])
    ends = np.cumsum(m)
    swapped = wrong[ends] - wrong[ends - m]
    with np.errstate(divide="ignore", invalid="ignore"):
        s = np.where(m > 0, (m / la + m / lb + (m - swapped // 2) / m) / 3, 0.0)
    s[(la == 0) & (lb == 0)] = 1.0
    prefix, same = np.zeros(len(x), np.int64), np.ones(len(x), bool)
    for i in range(min(4, len(at), len(bt))):
        same &= at[i] == bt[i]
        prefix += same
    return np.where(s > floor, s + prefix * weight * (1 - s), s)


def _jaro_winkler(x: pa.Array, y: pa.Array) -> pa.Array:
    null = pc.or_(pc.is_null(x), pc.is_null(y))
    short = pc.and_(pc.less_equal(pc.utf8_length(x), SHORT), pc.less_equal(pc.utf8_length(y), SHORT)).fill_null(False).to_numpy(zero_copy_only=False)
    out = np.zeros(len(x))
    if short.all():
        out = _jaro_winkler_short(x, y) if len(x) else out
    else:
        mask = pa.array(short)
        if short.any():
            out[short] = _jaro_winkler_short(x.filter(mask), y.filter(mask))
        rest = np.flatnonzero(~short & ~null.to_numpy(zero_copy_only=False))
        out[rest] = [jaro_winkler_py(p, q) for p, q in zip(x.take(pa.array(rest)).to_pylist(), y.take(pa.array(rest)).to_pylist(), strict=True)]
    return pa.array(out, pa.float64(), mask=null.to_numpy(zero_copy_only=False))


def jaro_winkler(a, b) -> Column:
    """0 to 1; null if either is null."""
    @F.arrow_udf("double")
    def f(x: pa.Array, y: pa.Array) -> pa.Array:
        return _jaro_winkler(x.cast(pa.string()), y.cast(pa.string()))

    return f(a, b)


def _listed(df: DataFrame, unique: str, block: str, name: str) -> DataFrame:
    """One row for the rows of a block that have the same name, with their numbers as a list; several for many rows."""
    n = df.groupBy(F.col(block).alias("__b"), F.col(name).alias("__a")).agg(F.count("*").alias("__n"))
    x = df.join(n, (F.col(block) == F.col("__b")) & F.col(name).eqNullSafe(F.col("__a")))
    part = F.pmod(F.xxhash64(unique), F.ceil(F.col("__n") / COPIES))
    return x.groupBy(block, name, part.alias("__part")).agg(F.collect_list(F.struct(unique)).alias(f"__{unique}")).drop("__part")


def similarities(left: DataFrame, right: DataFrame, lid: str, rid: str, block: str, lname: str, rname: str, measure=jaro_winkler) -> DataFrame:
    """(lid, rid, similarity) of all rows of either side in one block. A pair of names is compared once for all rows that
    have them; the pairs are dealt to tasks by their number, as all of them are to be returned."""
    many = left.groupBy(block).agg(F.count("*").alias("n")).join(right.groupBy(block).agg(F.count("*").alias("m")), block).agg(F.sum(F.col("n").cast("double") * F.col("m"))).first()[0]
    tasks = int((many or 0) // PAIRS) + 1
    a, b = _listed(left, lid, block, lname), _listed(right, rid, block, rname)
    pairs = a.repartition(tasks).join(limited(b, b.count()), block).withColumn("similarity", measure(lname, rname))
    x = pairs.select(F.explode(f"__{lid}").alias("__l"), f"__{rid}", "similarity").select("__l", F.explode(f"__{rid}").alias("__r"), "similarity")
    return x.select(F.col(f"__l.{lid}").alias(lid), F.col(f"__r.{rid}").alias(rid), "similarity")


def token_set_ratio(a, b) -> Column:
    """0 to 100; null if either is null."""
    @F.pandas_udf("double")
    def f(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else token_set_ratio_py(p, q) for p, q in zip(x, y, strict=True)], dtype="float64")

    return f(a, b)
