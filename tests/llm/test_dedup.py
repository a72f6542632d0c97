import collections
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from claimlens.llm import exact_dup, near_dup

import brute


@pytest.mark.parametrize("pairs", [near_dup.PAIRS, 0])
def test_near_duplicates(docs, rows, pairs):
    sets = {r[0]: brute.shingles(r[1]) for r in rows}
    want = {k: (len(sets[k]), c) for k, c in brute.components(sets).items()}
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_duplicates(docs, pairs=pairs).collect()}
    assert got == want
    assert len({c for _, c in want.values()}) < len(rows) - 30


def test_near_edge_cases(spark, docs, rows, none, clashing):
    assert near_dup.near_duplicates(none).count() == 0
    assert near_dup.keep_one(none).count() == 0
    kept = near_dup.keep_one(clashing)
    sets = {r[0]: brute.shingles(r[1]) for r in rows}
    assert kept.columns == clashing.columns
    assert {r.doc_id for r in kept.select("doc_id").collect()} == set(brute.components(sets).values())
    odd = docs.withColumn("doc_id", F.when(F.col("doc_id") > 2, F.col("doc_id"))).limit(40).union(docs.limit(3))
    assert near_dup.near_duplicates(odd).where("doc_id is null").count() == 0


def test_exact_duplicates(docs, rows, none, clashing):
    want = brute.exact([r[:2] for r in rows])
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dup.exact_duplicates(docs).collect()}
    assert got == {k: v[:2] for k, v in want.items()}
    assert exact_dup.exact_duplicates(none).count() == 0
    kept = exact_dup.keep_first(clashing)
    assert kept.columns == clashing.columns
    assert {r.doc_id for r in kept.select("doc_id").collect()} == {v[0] for v in want.values()}


def test_exact_repeated_rows(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, "a "), (3, "b"), (None, "a"), (None, None), (4, "")], "doc_id long, text string")
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.keep_id or 0, r.group_size) for r in exact_dup.exact_duplicates(df).collect()))
    assert got == [(False, 1, 1, 2), (False, 1, 1, 3), (False, 1, 1, 3), (False, 2, 2, 1), (False, 3, 1, 2), (False, 4, 4, 2), (True, 0, 1, 3), (True, 0, 4, 2)]


def test_keep_first_tells_rows_apart(spark):
    rows = [(1, "a", "p"), (1, "a", "p"), (2, "b", "p"), (2, "a", "p"), (None, "a", "p"), (None, "own", "p"), (None, "two", "p"), (None, "two", "q"), (3, "b", "p"), (4, None, "p"), (4, "", "p")]
    kept = exact_dup.keep_first(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in kept) == [(0, "own"), (0, "two"), (1, "a"), (2, "b"), (4, "")]


def test_exact_query_keeps_null_ids(spark, tmp_path):
    rows = [(1, "a"), (1, "a"), (None, "a"), (None, "own"), (None, None), (2, "b"), (2, "c")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    sha = {t: hashlib.sha256(t.encode()).hexdigest() for t in ("a", "own", "", "b", "c")}
    got = sorted((r.doc_id or 0, r.keep_id or 0, r.group_size, r.kept, r.text_sha256) for r in exact_dup.op5_exact_dedup(spark, str(tmp_path)).collect())
    want = [(0, 0, 1, None, sha["own"]), (0, 0, 1, None, sha[""]), (0, 1, 3, None, sha["a"]), (1, 1, 3, True, sha["a"]), (1, 1, 3, True, sha["a"]), (2, 2, 1, True, sha["b"]), (2, 2, 1, True, sha["c"])]
    assert sorted(got, key=str) == sorted(want, key=str)


@pytest.mark.parametrize("pairs", [near_dup.PAIRS, 0])
def test_near_repeated_rows(spark, docs, rows, pairs):
    sets = {r[0]: brute.shingles(r[1]) for r in rows}
    want = {(k, len(sets[k]), c): 2 for k, c in brute.components(sets).items()}
    got = collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in near_dup.near_duplicates(docs.union(docs), pairs=pairs).collect())
    assert got == want


def test_near_repeated_rows_below_threshold(spark):
    words = [f"w{i}" for i in range(300)]
    a, b, near, own = " ".join(words[:104]), " ".join(words[60:164]), " ".join(words[:103]), " ".join(words[200:])
    twice = spark.createDataFrame([(1, a), (2, b)] * 2, "doc_id long, text string").coalesce(1)
    assert {(r.doc_id, r.component_id) for r in near_dup.near_duplicates(twice).collect()} == {(1, 1), (2, 2)}
    # an id with a near copy of another text and one of its own loses the near copy only
    mixed = spark.createDataFrame([(1, a), (2, near), (2, own)], "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in near_dup.keep_one(mixed).collect()) == [(1, a), (2, own)]


def test_near_query_is_whole_on_hot_blocks(spark):
    """Texts that share one passage but don't link, and a long chain of near copies, with one pivot a round and with many."""
    rnd = random.Random(8)
    word = lambda: "w" + str(rnd.randrange(10**6))
    passage, base, texts = [word() for _ in range(60)], [word() for _ in range(100)], []
    for _ in range(40):
        texts.append(" ".join(passage + [word() for _ in range(rnd.randrange(10, 25))]))
    chain = list(base)
    for i in range(40):
        chain[(2 * i) % 100] = word()
        texts.append(" ".join(chain))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = {i: brute.shingles(t) for i, t in enumerate(texts)}
    want = brute.components(sets)
    for pairs in (0, near_dup.PAIRS):
        assert {r.doc_id: r.component_id for r in near_dup.near_duplicates(df, pairs=pairs).collect()} == want
    assert len(set(want.values())) < len(texts)
