import time

import corpus_pipeline
from claimlens.llm import mixing, quality

import brute


def test_stages(spark, rows, docs, labels, tmp_path):
    sf = str(tmp_path)
    docs.write.parquet(f"{sf}/documents.parquet")
    labels.write.parquet(f"{sf}/labels.parquet")
    frame, order = docs, None
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, frame, sf)
        assert out.columns == docs.columns, name
        out.write.parquet(f"{sf}/{name}")
        before, frame = {r.doc_id: r.text for r in frame.collect()}, spark.read.parquet(f"{sf}/{name}")
        kept = {r.doc_id for r in frame.collect()}
        if name == "quality":
            score = {r.doc_id: r.score for r in quality.score(docs, quality.fit(docs, quality.training_labels(labels))).collect()}
            assert kept == {i for i, s in score.items() if s >= quality.THRESHOLD}
        elif name == "exact_dedup":
            assert kept == {v[0] for v in brute.exact(before.items()).values()}
        elif name == "near_dedup":
            assert kept == set(brute.components({i: brute.shingles(t) for i, t in before.items()}).values())
        else:
            assert kept == set(before)
            order = len(kept)
    last = corpus_pipeline.STAGES[-1][1](spark, frame, sf)
    assert last.count() == order == corpus_pipeline.run(spark, sf).count()


def test_empty(spark, none, labels, tmp_path):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    frame = none
    for _, stage in corpus_pipeline.STAGES:
        frame = stage(spark, frame, str(tmp_path))
        assert frame.count() == 0


def test_encoded_rows_follow_the_mix(spark, docs, tmp_path):
    """Many files of unequal size: Spark reads them in another order than they were written."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        corpus_pipeline.mix_stage(spark, docs, "").write.parquet(f"{tmp_path}/mixed")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    stored = spark.read.parquet(f"{tmp_path}/mixed")
    assert len(stored.inputFiles()) > 1
    got = {r.position: r.doc_id for r in corpus_pipeline.encode_stage(spark, stored, "").collect()}
    want = [r.doc_id for r in sorted(mixing.schedule(docs).collect(), key=lambda r: r.position)]
    assert sorted(got) == list(range(len(want))) and [got[i] for i in range(len(want))] == want


def test_executors_settle_before_encoding(spark, docs):
    left = spark.sparkContext._jvm.java.util.WeakHashMap()
    left.put("a string of the JVM that nothing else holds", 1)
    assert corpus_pipeline.encode_stage(spark, docs, "").columns == ["doc_id", "n_tokens", "ids", "position"]
    for _ in range(50):  # the map learns of it a little later
        if not left.size():
            break
        time.sleep(0.1)
    assert not left.size()
