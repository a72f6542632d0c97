"""SentencePiece encoding and decoding by a distinct-chunk table: where no piece of the model crosses a whitespace
marker, a marked word is segmented the same wherever it stands, so each distinct one is segmented once and its ids
are joined back by position.

The table belongs to a task: a table of the whole corpus would have to be shuffled to every position of every
word, which moves more than the texts themselves (figures in the README). It has two generations of at most half
TABLE_ROWS entries each (and what one part of the texts adds), of which the older is forgotten when the younger is full,
but for what is used again; so its memory is bounded, frequent chunks stay, and no result changes. A model whose pieces cross markers, or whose normaliser changes characters or
white space, is run on whole texts instead."""

from __future__ import annotations

import gc
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from claimlens.llm.common import documents, given_back

TABLE_ROWS = 160_000
#: Longer chunks are segmented where they stand and not kept.
TABLE_CHARS = 64
MARK = "▁"
#: Characters of the texts that are encoded together; a longer text is on its own.
PART_CHARS = 1_000_000
CHUNK = re.compile(f"[ {MARK}]+[^ {MARK}]*")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def load(path: str) -> bytes:
    """The model's file, read by the driver; it goes to the executors with the task (a vocabulary is a few MB)."""
    with open(path, "rb") as f:
        return f.read()


def _fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol buffer."""
    at = 0

    def number() -> int:
        nonlocal at
        value, shift = 0, 0
        while True:
            byte = message[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(message):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
        else:
            size = {1: 8, 5: 4}.get(key & 7) or number()
            yield key >> 3, message[at : at + size]
            at += size


def plain_normaliser(model: bytes) -> bool:
    """Whether the model's normaliser puts one marker before a text, makes each space a marker and changes nothing else."""
    spec = dict(_fields(dict(_fields(model)).get(3, b"")))
    return not spec.get(2) and spec.get(3, 1) == 1 and spec.get(4, 1) == 0 and spec.get(5, 1) == 1


class Encoder:
    """The library's encode and decode, by a table of distinct chunks."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size())]
        self.by_chunk = plain_normaliser(model) and MARK in pieces and not any(MARK in p.lstrip(MARK) for p in pieces)
        self.end = self.sp.eos_id()
        self.mark = (self.sp.piece_to_id(MARK),)
        #: chunk: number of ids, ids as text, decoded text (None where it is the chunk itself)
        self.table: dict[str, tuple[int, str, str | None]] = {}
        self.older: dict[str, tuple[int, str, str | None]] = {}

    def chunks(self, text: str) -> list[str]:
        """The chunks of a text, each without its first marker."""
        if not self.by_chunk:
            return [text] if text else []
        if not text:
            return []
        if MARK not in text and "  " not in text and text[0] != " " and text[-1] != " ":
            return text.split(" ")
        return [c[1:] for c in CHUNK.findall(" " + text)]

    def encode(self, texts: list[str]) -> Iterator[tuple[int, str, str]]:
        """For each text its number of ids, ids as text and decoded text, without the end id."""
        lists = [self.chunks(t) for t in texts]
        if len(self.table) > TABLE_ROWS // 2:
            self.table, self.older = {}, self.table
        table, older, long, new = self.table, self.older, {}, []
        for c in dict.fromkeys([c for x in lists for c in x]):
            if c not in table:
                if c in older:
                    table[c] = older[c]
                else:
                    new.append(c)
        for i in range(0, len(new), 20_000):
            part = new[i : i + 20_000]
            ids = self.sp.encode(part, num_threads=1)
            decoded = self.sp.decode(ids, num_threads=1)
            for c, x, t in zip(part, ids, decoded, strict=True):
                if not c:  # a marker with nothing after it; the library does not see it in an empty text
                    x, t = self.mark, ""
                (table if len(c) <= TABLE_CHARS else long)[c] = (len(x), " ".join(map(str, x)), None if c == t else t)
        for x in lists:
            found = [table[c] if c in table else long[c] for c in x] if long else [table[c] for c in x]
            decoded = " ".join([c if r[2] is None else r[2] for c, r in zip(x, found, strict=True)])
            yield sum([r[0] for r in found]), " ".join([r[1] for r in found]), decoded

    def decode(self, ids: list[int]) -> str:
        return self.sp.decode(ids)


def _each(batches, model: bytes, make, schema: pa.Schema):
    encoder = Encoder(model)
    for x in batches:
        ids, texts = x.column(0), x.column(1)
        lo = 0
        while lo < len(texts):
            part, size = [], 0
            while lo + len(part) < len(texts) and len(part) < 512 and size < PART_CHARS:
                part.append(texts[lo + len(part)].as_py() or "")
                size += len(part[-1])
            gc.disable()  # the table has no cycles, and walking it again and again takes longer than the rest
            try:
                out = [make(encoder, r) for r in (encoder.encode(part) if make is not _text else part)]
            finally:
                gc.enable()
            passed = [x.column(j).slice(lo, len(part)) for j in range(2, x.num_columns)]
            made = list(schema)[1 : len(schema) - len(passed)]
            yield pa.record_batch([ids.slice(lo, len(part)).cast(schema.field(0).type), *(pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), made, strict=True)), *passed], schema=schema)
            lo += len(part)


def _text(encoder: Encoder, ids):
    return (encoder.decode(list(ids)) if len(ids) else "",)


def _ids(encoder: Encoder, row: tuple[int, str, str]):
    return row[0] + 1, np.append(np.fromstring(row[1], np.int32, sep=" "), np.int32(encoder.end))


def encode(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", model: str | None = None, position: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids (array of int, an end id last) of every row, as the library encodes the whole text; null
    counts as empty, whose only id is the end id. position: a column of long that is carried along as position. Other
    columns aren't read."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32()))] + [("position", pa.int64())] * bool(position))
    data = load(model or default_model())
    columns = [f"cast(`{doc_id}` as long)", f"`{text}`"] + [f"cast(`{position}` as long)"] * bool(position)
    return docs.selectExpr(*columns).mapInArrow(lambda it: given_back(_each(it, data, _ids, schema)), "doc_id long, n_tokens long, ids array<int>" + ", position long" * bool(position))


def decode(encoded: DataFrame, doc_id: str = "doc_id", ids: str = "ids", model: str | None = None) -> DataFrame:
    """doc_id, text of every row of ids; the end id has no text, null ids give an empty text."""
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])
    data = load(model or default_model())
    return encoded.selectExpr(f"cast(`{doc_id}` as long)", f"`{ids}`").mapInArrow(lambda it: given_back(_each(it, data, _text, schema)), "doc_id long, text string")


def _digests(encoder: Encoder, row: tuple[int, str, str]):
    n, ids, decoded = row
    return n + 1, hashlib.sha256(f"{ids} {encoder.end}".lstrip().encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
    data = load(default_model())
    return documents(spark, sf_dir).select("doc_id", "text").mapInArrow(lambda it: given_back(_each(it, data, _digests, schema)), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
