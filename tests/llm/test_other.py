import collections
import hashlib
import io
import wave
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimlens.llm import audio, mixing, url_filter


@pytest.mark.parametrize("up,down", [(1, 4), (1, 2), (3, 2), (2, 3), (1, 1)])
def test_resample(up, down):
    rng = np.random.default_rng(0)
    for n in (1, 3, 64, 500, 1001):
        x = rng.normal(size=n).astype(np.float32)
        h = audio.low_pass(up, down)
        z = np.zeros(n * up)
        z[::up] = x
        full, d = np.convolve(z, h), (len(h) - 1) // 2
        want = [full[i * down + d] if i * down + d < len(full) else 0 for i in range(-(-n * up // down))]
        assert np.allclose(audio.resample(x, up, down), want, atol=1e-4)


def wav(samples, rate=audio.RATE, channels=1, width=1):
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(width)
        w.setframerate(rate)
        w.writeframes(samples)
    return out.getvalue()


def test_log_mel():
    """Against a plain transform of every frame."""
    f = audio.Features()
    for n in (0, 64, 512, 700, 5000):
        raw = np.random.default_rng(n).integers(0, 256, n).astype(np.uint8).tobytes()
        y = f.low(raw)
        count = 1 + max(0, -(-(len(y) - audio.FRAME) // audio.HOP))
        y = np.concatenate((y, np.zeros(audio.FRAME + count * audio.HOP)))
        k = np.arange(audio.FRAME // 2 + 1)[:, None] * np.arange(audio.FRAME) / audio.FRAME
        want = []
        for i in range(count):
            x = y[i * audio.HOP : i * audio.HOP + audio.FRAME] * f.window
            power = (x * np.cos(2 * np.pi * k)).sum(axis=1) ** 2 + (x * np.sin(2 * np.pi * k)).sum(axis=1) ** 2
            want.append(np.log10(power @ f.mel + 1e-6))
        got = f.log_mel(raw)
        assert got.shape == (count, audio.MELS) and np.allclose(got, want, atol=1 / 64)
        assert count * audio.HOP + audio.FRAME - audio.HOP >= len(f.low(raw))  # every sample is in a frame


def test_segments():
    f = audio.Features()
    rnd = np.random.default_rng(3)
    for _ in range(50):
        mel = rnd.normal(0, 0.3, (rnd.integers(1, 60), audio.MELS)).cumsum(axis=0)
        e = [10 * float(x) for x in mel.mean(axis=1)]
        mid, want, start, loud = float(np.median(e)), [], None, False
        for i, x in enumerate([*e, -np.inf]):
            if x > mid + audio.LOW_DB:
                start, loud = (i if start is None else start), loud or x > mid + audio.HIGH_DB
            elif start is not None:
                if loud:
                    want.append((start * audio.HOP / f.rate, ((i - 1) * audio.HOP + audio.FRAME) / f.rate))
                start, loud = None, False
        assert f.segments(mel) == want


def test_audio_features(spark):
    f = audio.Features()
    raw = np.random.default_rng(1).integers(0, 256, 700_000).astype(np.uint8).tobytes()
    whole = audio.resample((np.frombuffer(raw, np.uint8).astype(np.float32) - 128) / 128, 1, 4)
    assert np.array_equal(whole, f.low(raw))
    t = np.arange(64_000) / audio.RATE
    tone = np.where((t > 1) & (t < 2), 100, 1) * np.sin(2 * np.pi * 440 * t) + 128
    (a, b), = f.segments(f.log_mel(tone.astype(np.uint8).tobytes()))
    assert abs(a - 1) < 0.1 and abs(b - 2) < 0.1
    media = [(1, wav(raw)), (2, None), (3, wav(b"")), (4, b"junk"), (5, wav(b"abcd" * 9, channels=2)), (6, wav(b"abcd" * 9, width=2)), (7, b""), (8, wav(raw[:999], rate=8000)), (8, wav(raw[:999], rate=8000)), (None, wav(raw)[:60])]
    df = spark.createDataFrame([(i, m and bytearray(m), "x", 7) for i, m in media], "item_id long, media binary, problem string, n_bytes int")
    got = {r.item_id: r for r in audio.audio_features(df, keep=("n_bytes",)).collect()}
    assert len(got) == 9 and {r.n_bytes for r in got.values()} == {7}
    assert got[2].problem is None and got[2].media_bytes is None
    assert all(got[i].problem and got[i].tensors is None and got[i].media_bytes == len(dict(media[:8])[i]) for i in (4, 5, 6, 7))
    for i in (1, 3, 8):
        table = audio.read_tensors(bytes(got[i].tensors))
        assert table.column("tensor").type == audio.TENSOR_TYPE
        x = table.column("tensor").combine_chunks().to_numpy_ndarray()
        assert x.shape == (-(-got[i].n_frames // audio.TENSOR), audio.TENSOR, audio.MELS)
        if i != 8:
            mel = f.log_mel(raw if i == 1 else b"")
            assert np.array_equal(x.reshape(-1, audio.MELS)[: len(mel)], mel)
        starts, ends = (table.column(c).to_numpy() for c in ("start_s", "end_s"))
        assert (ends > starts).all() and (starts[1:] > starts[:-1]).all()
    assert audio.audio_features(df.limit(0)).count() == 0


def test_audio_digests(spark, docs, rows, none, clashing, tmp_path):
    clashing.union(clashing.where("doc_id < 3")).write.parquet(f"{tmp_path}/documents.parquet")
    got = audio.op6_media_audio(spark, str(tmp_path)).collect()
    assert len(got) == len(rows) + 3
    features = {}
    for g in got:
        text = rows[g.doc_id][1]
        data = (text or "").encode()
        padded = data + bytes(max(64, -(-len(data) // 64) * 64) - len(data))
        assert (g.n_bytes, g.payload_bytes, g.payload_sha256, g.tail_crc32) == (len(data), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        assert g.media_sha256 == hashlib.sha256(wav(padded)).hexdigest() and g.media_bytes == len(wav(padded))
        assert features.setdefault(text or "", g.feature) == g.feature
    assert len(set(features.values())) > 0.9 * len(features)
    assert audio.media_column(none).count() == 0


def test_pfair():
    shares = mixing.quanta({"a": 5.0, "b": 3.0, None: 1.0, "c": 0.01})
    one = mixing.period(shares)
    total = sum(shares.values())
    seen = collections.Counter()
    for slot, (s, k, release, due) in enumerate(one):
        assert release <= slot < due
        seen[s] += 1
        assert k == seen[s]
        assert all(abs(seen[x] - (slot + 1) * shares[x] / total) < 1 for x in shares)
    assert seen == collections.Counter(shares)


def test_mixing(spark, docs, rows, none, clashing):
    got = mixing.schedule(docs, block_rows=4).collect()
    assert sorted(r.doc_id for r in got) == [r[0] for r in rows]
    assert len({r.position for r in got}) == len(rows)
    by = collections.defaultdict(set)
    for r in got:
        by[r.slot].add((r.source, r.block))
    assert all(len(v) == 1 for v in by.values()) and sorted(by) == list(range(len(by)))
    sizes = collections.Counter(r[3] for r in rows)
    assert len(by) == sum(-(-n // 4) for n in sizes.values())
    weights = mixing.schedule(docs, {"s1": 3.0, "s2": 1.0}, block_rows=1).collect()
    assert len(weights) == len(rows)
    assert mixing.schedule(none).count() == 0 and mixing.mixed(none).count() == 0
    out = mixing.mixed(clashing)
    assert out.columns == clashing.columns and out.count() == len(rows)
    nulls = docs.select(F.when(F.col("doc_id") % 3 > 0, F.col("doc_id")).alias("doc_id"), "source")
    assert mixing.schedule(nulls).select("position").distinct().count() == len(rows)
    assert mixing.mixed(nulls).count() == len(rows)
    twice = docs.select("doc_id", "source").union(docs.select("doc_id", "source"))
    again = mixing.schedule(twice, block_rows=4)
    assert again.count() == 2 * len(rows) == again.select("position").distinct().count()
    with pytest.raises(ValueError):
        mixing.schedule(docs, {"s1": -1.0})


def test_ranks_over_runs_of_buckets(spark, monkeypatch):
    """Small buckets and runs: rows still get the places 0, 1, ... of their source in the order of their hash."""
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 4)
    monkeypatch.setattr(mixing, "RUN", 5)
    df = spark.range(1000).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.pmod(F.col("id") * F.col("id"), F.lit(7))).alias("source"))
    by = collections.defaultdict(list)
    for r in mixing.schedule(df, block_rows=8).collect():
        by[r.source].append(r.block * 8 + r.place)
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and sum(map(len, by.values())) == 1000


def test_block_size():
    assert mixing.block_size(0) == mixing.block_size(64 << 22) == 64 and mixing.block_size((64 << 22) + 1) == 128
    assert mixing.block_size(10**11) * mixing.MAX_BLOCKS >= 10**11


def test_plan_places_every_block():
    blocks = {"a": 1000, "b": 37, "c": 1, None: 250}
    table = mixing.plan(blocks, {"a": 1.0, "b": 1.0, "c": 5.0, None: 2.0})
    slots = collections.defaultdict(list)
    for s, _, lo, hi, share, length, k, turn, start, _, _ in table:
        for block in range(lo + k, hi, share):
            slots[s].append((block, start + (block - lo) // share * length + turn))
    assert {s: len(v) for s, v in slots.items()} == blocks
    assert sorted(x for v in slots.values() for _, x in v) == list(range(sum(blocks.values())))
    assert all([x for _, x in sorted(v)] == sorted(x for _, x in v) for v in slots.values())


@pytest.mark.parametrize("weights", [{"a": 9, "b": 1}, {"a": 0.7, "b": 0.2, "c": 0.1}, {"hot": 333_333**0.5} | {f"s{i}": 33_333**0.5 for i in range(20)}, {"hot": 100.0} | {f"s{i}": 1.0 for i in range(200)}])
def test_plan_follows_the_given_weights(weights):
    blocks = {s: 2_000 if s in ("a", "hot") else 700 for s in weights}
    table = mixing.plan(blocks, weights)
    turns = sorted((start + (block - lo) // share * length + turn, s) for s, _, lo, hi, share, length, k, turn, start, _, _ in table for block in range(lo + k, hi, share))
    total, seen = sum(weights.values()), collections.Counter()
    for slot, s in turns:
        seen[s] += 1
        assert all(abs(seen[x] - (slot + 1) * w / total) < 1 + 1e-9 for x, w in weights.items())
        if seen[s] == blocks[s]:
            break
    assert slot > 700


def test_urls(spark):
    urls = ["http://www.Spam.example.net:80/a/?utm_x=1&b=2&a=1#f", "http://spam.example.net/a?a=1&b=2", "http://x.com/fr/1", "https://com/de/", "http://a.example.org/en/12", "http://a.example.org/es", "no scheme", None, "", "http://", "ftp://é.net?q", "http://ok.net/\n?x"] + ["http://hot.net/x"] * 20
    pages = spark.createDataFrame([(i, u, "h", "v") for i, u in enumerate(urls)] + [(None, "http://x.com/de/1", "", "")], "page_id long, url string, host string, verdict string")
    listed = spark.createDataFrame([("spam.example.net/a?a=1&b=2",), ("spam.example.net/a?a=1&b=2",), (None,), ("hot.net/x",)], "canonical string")
    assert url_filter.judge(pages, listed).columns == ["page_id", "host", "path", "canonical", "rule", "verdict"]
    got = {r.page_id: r for r in url_filter.judge(pages, listed).collect()}
    assert len(got) == len(urls) + 1 and got[None].verdict == "block"
    assert [got[i].verdict for i in range(12)] == ["block", "block", "allow", "block", "block", "allow", "allow", "allow", "allow", "allow", "allow", "allow"]
    assert [got[i].rule for i in (2, 3, 4, 5)] == ["com/fr/", "com/de/", "example.org/en/1", "org/"]
    assert (got[0].host, got[0].path) == ("www.spam.example.net:80", "/a/") and (got[6].host, got[6].path) == ("", "")
    assert all(got[i].verdict == "block" for i in range(12, 32))
    assert got[10].host == "é.net"
    assert url_filter.judge(pages.limit(0), listed).count() == 0
    assert {r.verdict for r in url_filter.judge(pages, listed.limit(0)).where("page_id >= 12").collect()} == {"allow"}


def test_listed_urls_hosts_and_folders(spark):
    listed = spark.createDataFrame([("bad.net/",), ("some.net/a/b/",), ("one.net/p",), ("q.net/p?a=1",)], "canonical string")
    urls = {"http://bad.net": 1, "http://x.bad.net/any/where?q=1": 1, "http://notbad.net/": 0, "http://net/": 0, "http://some.net/a/b": 1, "http://some.net/a/b/c/d/e": 1, "http://some.net/a/bc": 0, "http://some.net/a": 0, "http://one.net/p?x=1": 1, "http://one.net/q": 0, "http://one.net/": 0, "http://q.net/p?a=1": 1, "http://q.net/p": 0, "http://q.net/p?a=2": 0}
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    got = {r.page_id: r.verdict for r in url_filter.judge(pages, listed, rules=()).collect()}
    assert [got[i] for i in range(len(urls))] == [("allow", "block")[x] for x in urls.values()]


def test_bloom_has_no_false_negatives(spark):
    from pyspark.sql import functions as F

    urls = spark.range(3000).select(F.lit("h.net").alias("host"), F.concat(F.lit("/"), "id").alias("path"), F.lit("").alias("query"), F.concat(F.lit("h.net/"), "id").alias("canonical"))
    listed = urls.where("canonical like '%7'").select("canonical")
    assert url_filter.listed_urls(urls, listed).count() == 300
    shared = spark.sparkContext.broadcast(url_filter.bloom(listed, "canonical"))
    passed = urls.select(F.xxhash64("canonical").alias("h"), "canonical").mapInArrow(url_filter._possible(shared), "h long, canonical string").count()
    assert 300 <= passed < 400
