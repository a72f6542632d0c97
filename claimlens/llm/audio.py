"""Media columns: audio stored losslessly as 8-bit WAV; features by polyphase resampling, overlapped log-mel
filterbanks and hysteresis energy segmentation, stored as fixed-shape Arrow tensors with time spans.

Each row is read, featured and written on its own, so equal media have equal features and one long item needs
memory for itself only (samples are resampled in blocks). The tensors of an item are one Arrow stream, in a binary
column: Spark has no type of its own for them, and the stream keeps their shape wherever it is read."""

from __future__ import annotations

import hashlib
import io
import struct
import wave
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from claimlens.llm.common import documents, given_back

RATE, UP, DOWN = 16_000, 1, 4
FRAME, HOP, MELS = 128, 64, 16
#: Frames in one tensor; the last one of an item is filled with zeros.
TENSOR = 16
HIGH_DB, LOW_DB = 3.0, 0.0
BLOCK = 1 << 18
PAD = 64


def to_wav(samples: bytes, rate: int = RATE) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(rate)
        w.writeframes(samples)
    return out.getvalue()


def from_wav(stored: bytes) -> tuple[bytes, int]:
    """(samples, rate). ValueError for what isn't 8-bit mono PCM."""
    try:
        with wave.open(io.BytesIO(stored), "rb") as w:
            if (w.getnchannels(), w.getsampwidth()) != (1, 1):
                raise ValueError("8-bit mono is expected")
            if w.getframerate() <= 0:
                raise ValueError("rate is not positive")
            return w.readframes(w.getnframes()), w.getframerate()
    except (wave.Error, EOFError, struct.error) as e:
        raise ValueError(f"not a WAV file: {e}") from e


def low_pass(up: int, down: int, half: int = 8) -> np.ndarray:
    """A Hann-windowed sinc that cuts at the lower of the two rates' limits; gain up."""
    m = max(up, down)
    t = np.arange(-half * m, half * m + 1)
    h = np.sinc(t / m) / m * np.hanning(len(t) + 2)[1:-1]
    return (h / h.sum() * up).astype(np.float32)


def resample(x: np.ndarray, up: int, down: int, h: np.ndarray | None = None) -> np.ndarray:
    """x at up/down times its rate: y[n] = sum of h[k] over x at (n * down - k + delay) / up where that is whole. Each
    of the filter's up * down phases is a short convolution at the low rate; nothing is computed that is then
    thrown away."""
    h = low_pass(up, down) if h is None else h
    delay, size = (len(h) - 1) // 2, -(-len(x) * up // down)
    out = np.zeros(size, np.float32)
    for r in range(up):  # outputs n = r, r + up, ... use the taps of one residue
        first = r * down + delay
        taps = h[first % up :: up]
        at, count = first // up, len(range(r, size, up))
        if not count:
            continue
        y = np.zeros(count, np.float32)
        for s in range(min(down, len(taps))):  # taps s, s + down, ... meet samples at - s, at - s + down, ...
            t = taps[s::down]
            lo = at - s - (len(t) - 1) * down
            need = count + len(t) - 1
            idx0, skip = lo, max(0, -(lo // down) if lo < 0 else 0)
            part = np.zeros(need, np.float32)
            src = x[idx0 + skip * down :: down][: need - skip]
            part[skip : skip + len(src)] = src
            y += np.convolve(part, t, "valid")
        out[r::up] = y
    return out


def mel_filters(rate: float, frame: int = FRAME, mels: int = MELS) -> np.ndarray:
    """Triangular filters, evenly spaced on the mel scale, as a matrix of bins by filters."""
    top = 2595 * np.log10(1 + rate / 2 / 700)
    edges = 700 * (10 ** (np.linspace(0, top, mels + 2) / 2595) - 1)
    f = np.arange(frame // 2 + 1) * rate / frame
    up = (f[:, None] - edges[:-2]) / (edges[1:-1] - edges[:-2])
    down = (edges[2:] - f[:, None]) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(up, down)).astype(np.float32)


class Features:
    """log_mel(samples) and segments(log_mel) at one rate."""

    def __init__(self, rate: int = RATE, up: int = UP, down: int = DOWN):
        self.up, self.down, self.rate = up, down, rate * up / down
        self.h = low_pass(up, down)
        self.window = np.hanning(FRAME + 1)[:-1].astype(np.float32)
        self.mel = mel_filters(self.rate)

    def low(self, samples: bytes) -> np.ndarray:
        raw = np.frombuffer(samples, np.uint8)
        edge = -(-len(self.h) // self.down) * self.down
        parts = []
        for lo in range(0, len(raw), BLOCK):  # a block and what the filter sees on both sides of it
            a, b = max(0, lo - edge), min(len(raw), lo + BLOCK + edge)
            y = resample((raw[a:b].astype(np.float32) - 128) / 128, self.up, self.down, self.h)
            skip = (lo - a) * self.up // self.down
            parts.append(y[skip : skip + -(-min(BLOCK, len(raw) - lo) * self.up // self.down)])
        return np.concatenate(parts) if parts else np.zeros(0, np.float32)

    def log_mel(self, samples: bytes) -> np.ndarray:
        """Overlapped frames; the last is filled with zeros, so that every sample is in one."""
        y = self.low(samples)
        y = np.concatenate((y, np.zeros(max(FRAME - len(y), -(len(y) - FRAME) % HOP), np.float32)))
        frames = np.lib.stride_tricks.sliding_window_view(y, FRAME)[::HOP]
        out = np.empty((len(frames), MELS), np.float32)
        for i in range(0, len(frames), 4096):
            power = np.abs(np.fft.rfft(frames[i : i + 4096] * self.window, axis=1)) ** 2
            # in steps of 1/64, so that equal samples have equal features on processors that round differently
            out[i : i + 4096] = np.round(64 * np.log10(power.astype(np.float32) @ self.mel + 1e-6)) / 64
        return out

    def segments(self, mel: np.ndarray) -> list[tuple[float, float]]:
        """Spans in seconds of runs of frames whose energy (mean log mel, dB) stays above the median by LOW_DB and somewhere is above it by HIGH_DB."""
        e = 10 * mel.mean(axis=1)
        mid = np.median(e)
        low, high = e > mid + LOW_DB, e > mid + HIGH_DB
        edge = np.flatnonzero(np.diff(np.concatenate(([False], low, [False])).astype(np.int8)))
        seen = np.concatenate(([0], np.cumsum(high)))
        return [(float(a * HOP / self.rate), float(((b - 1) * HOP + FRAME) / self.rate)) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True) if seen[b] > seen[a]]


def tensors(mel: np.ndarray, rate: float) -> tuple[np.ndarray, list[tuple[float, float]]]:
    """Tensors of TENSOR frames by MELS, and the time span of the frames that each holds."""
    n = -(-len(mel) // TENSOR)
    out = np.zeros((n, TENSOR, MELS), np.float32)
    out.reshape(-1, MELS)[: len(mel)] = mel
    return out, [(i * TENSOR * HOP / rate, ((min(len(mel), (i + 1) * TENSOR) - 1) * HOP + FRAME) / rate) for i in range(n)]


TENSOR_TYPE = pa.fixed_shape_tensor(pa.float32(), [TENSOR, MELS])
STORED = pa.schema([("tensor", TENSOR_TYPE), ("start_s", pa.float64()), ("end_s", pa.float64())])


def store_tensors(values: np.ndarray, spans: list[tuple[float, float]]) -> bytes:
    """Tensors and their time spans as an Arrow stream."""
    out = pa.BufferOutputStream()
    flat = pa.FixedSizeListArray.from_arrays(pa.array(values.reshape(-1)), TENSOR * MELS)
    with pa.ipc.new_stream(out, STORED) as w:
        w.write_batch(pa.record_batch([pa.ExtensionArray.from_storage(TENSOR_TYPE, flat), *(pa.array([x[i] for x in spans], pa.float64()) for i in (0, 1))], schema=STORED))
    return out.getvalue().to_pybytes()


def read_tensors(stored: bytes) -> pa.Table:
    """tensor (fixed shape: TENSOR frames by MELS), start_s and end_s of an item's tensors, in order."""
    with pa.ipc.open_stream(stored) as r:
        return r.read_all()


SPAN = pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())])
FEATURES = pa.schema([("item_id", pa.int64()), ("samples_bytes", pa.int64()), ("samples_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("n_frames", pa.int64()), ("tensors", pa.binary()), ("segments", pa.list_(SPAN)), ("problem", pa.string())])
FEATURES_SQL = "item_id long, samples_bytes long, samples_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, n_frames long, tensors binary, segments array<struct<start_s: double, end_s: double>>, problem string"


def _row(stored: bytes, made: dict[int, Features]) -> tuple:
    media = len(stored), hashlib.sha256(stored).hexdigest()
    try:
        samples, rate = from_wav(stored)
    except ValueError as e:
        return None, None, None, *media, None, None, None, str(e)
    if rate not in made:
        made[rate] = Features(rate)
    f = made[rate]
    mel = f.log_mel(samples)
    segments = [{"start_s": a, "end_s": b} for a, b in f.segments(mel)]
    return len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-PAD:]), *media, len(mel), store_tensors(*tensors(mel, f.rate)), segments, None


def _featured(batches, schema: pa.Schema):
    made: dict[int, Features] = {}
    for x in batches:
        for lo in range(0, len(x), 256):
            part = x.slice(lo, 256)
            rows = [_row(m.as_py(), made) if m.is_valid else (None,) * 9 for m in part.column(1)]
            columns = (pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), list(FEATURES)[1:], strict=True))
            yield pa.record_batch([part.column(0), *columns, *part.columns[2:]], schema=schema)


def audio_features(media: DataFrame, item_id: str = "item_id", stored: str = "media", keep: tuple[str, ...] = ()) -> DataFrame:
    """For every row of media (8-bit mono WAV files) item_id; samples_bytes, samples_sha256 and tail_crc32 (of the last
    64) of the samples read from it; media_bytes and media_sha256 of the file itself; n_frames of log-mel; tensors (see
    read_tensors); segments (array of start_s, end_s); problem; then the columns in keep. What is no such file has the
    media's columns and a problem, and nulls else; null media have nulls only. Other columns aren't read."""
    rows = media.select(F.col(item_id).cast("long").alias("item_id"), F.col(stored).alias("media"), *(F.col(k) for k in keep))
    extra = [rows.schema[k] for k in keep]
    schema = pa.schema([*FEATURES, *(to_arrow_schema(StructType(extra)))])
    sql = ", ".join([FEATURES_SQL, *(f"`{f.name}` {f.dataType.simpleString()}" for f in extra)])
    return rows.mapInArrow(lambda it: given_back(_featured(it, schema)), sql)


def _stored(batches):
    for x in batches:
        for lo in range(0, len(x), 1024):
            part = x.slice(lo, 1024)
            texts = [(t.as_py() or "").encode() for t in part.column(1)]
            media = [to_wav(t + bytes(-len(t) % PAD or (0 if t else PAD))) for t in texts]
            yield pa.record_batch([part.column(0), pa.array(media, pa.binary()), pa.array(map(len, texts), pa.int64())], names=["item_id", "media", "n_bytes"])


def media_column(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """item_id, media and n_bytes of every row: the UTF-8 bytes of its text (null: none) as samples of a WAV file, with
    bytes 0 up to a positive multiple of 64, and how many there are without those. Other columns aren't read."""
    rows = docs.select(F.col(doc_id).cast("long").alias("item_id"), F.col(text).alias("text"))
    return rows.mapInArrow(lambda it: given_back(_stored(it)), "item_id long, media binary, n_bytes long")


def op6_media_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = audio_features(media_column(documents(spark, sf_dir)), keep=("n_bytes",))
    spoken = F.format_string("%.3f", F.aggregate("segments", F.lit(0.0), lambda a, s: a + s["end_s"] - s["start_s"]))
    feature = F.concat_ws(":", "n_frames", F.size("segments"), spoken, F.substring(F.sha2("tensors", 256), 1, 16))
    columns = {"doc_id": "item_id", "n_bytes": "n_bytes", "payload_bytes": "samples_bytes", "payload_sha256": "samples_sha256", "tail_crc32": "tail_crc32", "media_bytes": "media_bytes", "media_sha256": "media_sha256"}
    return found.select(*(F.col(old).alias(new) for new, old in columns.items()), feature.alias("feature"))
