"""Language identification by string kernels: presence kernels over blended character n-grams (1 to 3), Nyström
landmarks and one-versus-rest kernel ridge regression, scored by batched matrix products.

k(x, y) counts the distinct n-grams that x and y share, normalised by k(x, x) and k(y, y). Characters are first mapped
to 64 symbols: not a letter, a to z, and 37 classes of other letters; case is folded. The model is fitted on at most
PER_LANGUAGE texts of each language, LANDMARKS of them landmarks; its size is bounded by the number of n-grams of 64
symbols (266,304). The kernel is linear in presence, so landmark matrix and regression weights are multiplied once
and a batch of texts is scored as presence matrix times that product. Texts are read whole."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from claimlens.llm.common import crc_mod, documents, given_back, unit_hash
from claimlens.session import discard, materialize

PER_LANGUAGE = 300
#: Rows of the sample over all languages; with very many languages each gives fewer.
MAX_TRAIN = 6_000
LANDMARKS = 40
RIDGE = 0.05
SIZE = 64 + 64**2 + 64**3
BLOCK = 1 << 20
_UND = "und"
_symbols: list[np.ndarray] = []


def _symbol(c: str) -> int:
    c = c.lower()[:1]
    if not c.isalpha():
        return 0
    return ord(c) - 96 if "a" <= c <= "z" else 27 + zlib.crc32(c.encode()) % 37


def symbols(text: str) -> np.ndarray:
    if not _symbols:
        _symbols.append(np.array([0 if 0xD800 <= i < 0xE000 else _symbol(chr(i)) for i in range(1 << 16)], np.int32))
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    wide = codes >= 1 << 16
    if wide.any():
        out = _symbols[0][np.where(wide, 0, codes)]
        out[wide] = [_symbol(chr(c)) for c in codes[wide]]
        return out
    return _symbols[0][codes]


def presence(text: str, flags: np.ndarray) -> bool:
    """Sets the flags of the n-grams that the text has; false if it has no letter."""
    letters = False
    for lo in range(0, len(text), BLOCK):  # two characters of overlap, so no n-gram is lost
        s = symbols(text[max(0, lo - 2) : lo + BLOCK])
        letters = letters or bool(s.any())
        flags[s] = True
        two = s[:-1] * 64 + s[1:]
        flags[two + 64] = True
        flags[two[:-1] * 64 + s[2:] + 64 + 64**2] = True
    return letters


def _codes(batches):
    schema = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("codes", pa.list_(pa.int32()))])
    flags = np.zeros(SIZE, bool)
    for x in batches:
        out = []
        for t in x.column(2):
            flags[:] = False
            presence(t.as_py() or "", flags)
            out.append(np.flatnonzero(flags).astype(np.int32))
        yield pa.record_batch([x.column(0), x.column(1), pa.array(out, schema.field(2).type)], schema=schema)


#: (languages, n-gram codes of the landmarks, weights: code by language). A tuple, as a broadcast's classes would have to
#: be installed on the executors.
Model = tuple[list[str], np.ndarray, np.ndarray]


def train(rows: list[tuple[int, str, np.ndarray]]) -> Model:
    languages = sorted({r[1] for r in rows})
    if not languages:
        return [], np.zeros(0, np.int64), np.zeros((0, 0), np.float32)
    marks = [r for lang in languages for r in [x for x in rows if x[1] == lang][:LANDMARKS]]
    vocab = np.unique(np.concatenate([r[2] for r in marks])).astype(np.int64)
    at = np.full(SIZE, -1, np.int64)
    at[vocab] = np.arange(len(vocab))

    def matrix(part):
        m = np.zeros((len(part), len(vocab)), np.float32)
        for i, r in enumerate(part):
            j = at[r[2]]
            m[i, j[j >= 0]] = 1 / np.sqrt(max(1, len(r[2])))
        return m

    land = matrix(marks)
    values, vectors = np.linalg.eigh((land @ land.T).astype(np.float64))
    good = values > 1e-8 * values[-1]
    root = vectors[:, good] / np.sqrt(values[good])  # K_LL to the power -1/2 up to a rotation
    gram, target = 0.0, 0.0
    for i in range(0, len(rows), 256):
        part = rows[i : i + 256]
        phi = (matrix(part) @ land.T).astype(np.float64) @ root
        y = np.where(np.array([r[1] for r in part])[:, None] == np.array(languages)[None, :], 1.0, -1.0)
        gram, target = gram + phi.T @ phi, target + phi.T @ y
    w = np.linalg.solve(gram + RIDGE * np.eye(len(gram)), target)
    return languages, vocab, (land.T.astype(np.float64) @ (root @ w)).astype(np.float32)


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """A model from the rows of docs that have an id, a text with characters and a language. Each language gives up
    to per_language rows, those with the smallest hash of their id, and all together MAX_TRAIN."""
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    docs = docs.where("lang is not null and doc_id is not null and length(text) > 0")
    counts = {r.lang: r.n for r in docs.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return train([])
    per_language = max(1, min(per_language, MAX_TRAIN // len(counts)))
    share = F.create_map(*[x for k, n in sorted(counts.items()) for x in (F.lit(k), F.lit(2.0 * per_language / n if n > 4 * per_language else 1.0))])
    u = unit_hash("doc_id", 11)
    sample = docs.where(u < share[F.col("lang")]).select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text")
    rows = materialize(sample.mapInArrow(lambda it: given_back(_codes(it)), "doc_id long, lang string, codes array<int>").withColumn("u", unit_hash("doc_id", 11)), "language-sample")
    # the sample has about 2 * per_language rows of a language
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("u", "doc_id", F.xxhash64("codes")))
    out = rows.withColumn("rank", rank).where(F.col("rank") <= per_language).collect()
    discard(rows)
    return train([(r.doc_id, r.lang, np.array(r.codes, np.int64)) for r in sorted(out, key=lambda r: (r.lang, r.rank))])


def predict(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred, score (0 to 1, the softmax of the regressions) of every row; und and 0 where the text is
    null, empty or has no letter, or where the model knows no language."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches):
        schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])
        languages, vocab, weights = shared.value
        flags = np.zeros(SIZE, bool)
        for x in batches:
            for lo in range(0, len(x), 256):
                part = x.slice(lo, 256)
                rows, seen = np.zeros((len(part), len(vocab)), np.float32), np.zeros(len(part), bool)
                for i, t in enumerate(part.column(1)):
                    if t := t.as_py():
                        flags[:] = False
                        seen[i] = presence(t, flags)
                        rows[i] = flags[vocab]
                        rows[i] /= np.sqrt(np.count_nonzero(flags))
                names, p = np.full(len(part), _UND, object), np.zeros(len(part))
                if languages:
                    s = (rows @ weights).astype(np.float64) * 3
                    s = np.exp(s - s.max(axis=1, keepdims=True))
                    best = s.argmax(axis=1)
                    names[seen] = np.array(languages, object)[best[seen]]
                    p[seen] = np.round((s.max(axis=1) / s.sum(axis=1))[seen], 6)
                yield pa.record_batch([part.column(0), pa.array(names.tolist(), pa.string()), pa.array(p)], schema=schema)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(lambda it: given_back(scored(it)), "doc_id long, lang_pred string, score double")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    model = fit(docs.where(crc_mod("doc_id", 4) != 2))
    return predict(docs, model).select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")
