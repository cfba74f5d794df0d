"""Quality classifier: a factorisation machine over hashed words, structure statistics and optional metadata.

A document is a sparse vector: its words, hashed to 2**BUCKET_BITS buckets and weighted by the root of their
share; its structure statistics, standardised, and again as one indicator for each statistic's quantile bin; and,
if metadata columns are named, one hashed indicator for each of them. The machine scores

    bias + sum w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)

in time linear in the words. It is fitted on the driver, by Adam on the log loss, on at most TRAIN_ROWS labelled
documents (those whose id hashes lowest) with at most TRAIN_BYTES of features, counted after labels have met their documents, see sample.py;
all documents are scored, in whole, where they lie, with the broadcast weights.

Null texts count as empty and have a score like all others. Labels other than 0 and 1 and labels without a
document are passed over; with no labels at all every score is 0.5. Different labels of one document count each, equal ones once. Other
columns are kept and of clashing names the operator's wins; repeated rows get equal scores, ties in a score the same prediction,
and an empty table an empty result. A text of any length is scored whole, as one row in one Python step. As inputs of the
machine the mean length of words counts up to 50 bytes and standardised statistics up to 4 either way; no row or word is left out.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, StructField, StructType

from .common import _Tables, mix, rows_of, text_slices, words
from .sample import labelled_rows

BUCKET_BITS = 14
RANK = 8
BINS = 8
#: Labelled rows, and bytes of their features, that are collected for fitting, at most.
TRAIN_ROWS, TRAIN_BYTES = 4_000, 64 << 20
#: Training rows whose gradients are held at a time.
FIT_ROWS = 400
STEPS, RATE, DECAY = 90, 0.05, 1e-3
THRESHOLD = 0.3

STATISTICS = "log_bytes word_bytes long_words upper digits punctuation symbols exclamations pipes spaces lines distinct_words repeated_lines ended_words capitalised short_words echoed_words".split()
_N = len(STATISTICS)
_WORDS = 1 << BUCKET_BITS
_META = 1 << 8
_SIZE = _WORDS + _N + _N * BINS + _META
_U = np.uint64


def _byte_set(chars: bytes) -> np.ndarray:
    out = np.zeros(256, np.uint8)
    out[list(chars)] = 1
    return out


_KINDS = {
    "upper": _byte_set(bytes(range(65, 91))),
    "digits": _byte_set(b"0123456789"),
    "punctuation": _byte_set(b".,;:?'\"()-"),
    "symbols": _byte_set(b"#$%&*+/<=>@[\\]^_`{}~"),
    "exclamations": _byte_set(b"!"),
    "pipes": _byte_set(b"|"),
    "spaces": _byte_set(b" \t\r\n\x0b\x0c"),
    "lines": _byte_set(b"\n"),
}
_ENDS = _byte_set(b".!?,;:").astype(bool)


@dataclass
class Features:
    stats: np.ndarray  # (rows, _N)
    row: np.ndarray  # of each distinct word bucket
    bucket: np.ndarray
    weight: np.ndarray


def _per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return (sums[offsets[1:]] - sums[offsets[:-1]]).astype(np.float64)


def features(data: np.ndarray, offsets: np.ndarray) -> Features:
    n = len(offsets) - 1
    size = np.diff(offsets).astype(np.float64)
    starts, ends, hashes = words(data, offsets)
    row = rows_of(starts, offsets)
    count = np.bincount(row, minlength=n).astype(np.float64)
    per_byte, per_word = np.maximum(size, 1), np.maximum(count, 1)
    key = (row.astype(np.uint64) << _U(BUCKET_BITS)) | (hashes >> _U(64 - BUCKET_BITS))
    distinct, times = np.unique(key, return_counts=True)
    own = (distinct >> _U(BUCKET_BITS)).astype(np.int64)
    length = (ends - starts).astype(np.float64)
    of_words = lambda flags: np.bincount(row, weights=flags.astype(np.float64), minlength=n) / per_word
    upper = _KINDS["upper"].astype(bool)
    stats = {name: _per_row(table[data], offsets) / per_byte for name, table in _KINDS.items()}
    stats["log_bytes"] = np.log1p(size)
    stats["word_bytes"] = np.minimum(np.bincount(row, weights=length, minlength=n) / per_word, 50.0)
    stats["long_words"] = of_words(length > 12)
    stats["distinct_words"] = np.bincount(own, minlength=n) / per_word
    stats["repeated_lines"] = _repeated_lines(data, offsets)
    stats["ended_words"] = of_words(_ENDS[data[ends - 1]])
    stats["capitalised"] = of_words(upper[data[starts]])
    stats["short_words"] = of_words(length <= 3)
    echoed = np.zeros(len(row), bool)
    echoed[1:] = (hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])
    stats["echoed_words"] = of_words(echoed)
    return Features(np.stack([stats[s] for s in STATISTICS], axis=1), own, (distinct & _U(_WORDS - 1)).astype(np.int64), np.sqrt(times / per_word[own]).astype(np.float32))


def _repeated_lines(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The share of each text's lines that an earlier line of it equals."""
    n = len(offsets) - 1
    if not len(data):
        return np.zeros(n)
    breaks = np.flatnonzero(data == 10) + 1
    bounds = np.unique(np.concatenate([offsets[:-1][np.diff(offsets) > 0], breaks[breaks < len(data)]]))
    t = _Tables.get()
    each = mix(t.byte[data] + (np.arange(len(data)) - np.repeat(bounds, np.diff(np.append(bounds, len(data))))).astype(np.uint64))
    hashes = np.add.reduceat(each, bounds)
    row = rows_of(bounds, offsets)
    order = np.lexsort((hashes, row))
    same = (hashes[order][1:] == hashes[order][:-1]) & (row[order][1:] == row[order][:-1])
    return np.bincount(row[order][1:][same], minlength=n) / np.maximum(1, np.bincount(row, minlength=n))


@dataclass
class Machine:
    bias: float
    w: np.ndarray
    v: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    edges: np.ndarray  # (_N, BINS - 1)


def _vector(m: Machine, f: Features, meta: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, index and value of all features, sorted by row."""
    n = len(f.stats)
    z = np.clip((f.stats - m.mean) / m.scale, -4, 4)
    bins = np.stack([np.searchsorted(m.edges[j], f.stats[:, j], side="right") for j in range(_N)], axis=1)
    rows = [f.row, np.repeat(np.arange(n), _N), np.repeat(np.arange(n), _N)]
    index = [f.bucket, np.tile(np.arange(_N) + _WORDS, n), (bins + np.arange(_N) * BINS).ravel() + _WORDS + _N]
    value = [f.weight, (z / 4).ravel(), np.full(n * _N, 0.25)]
    if meta is not None:
        rows.append(np.repeat(np.arange(n), meta.shape[1]))
        index.append(meta.ravel() + _WORDS + _N + _N * BINS)
        value.append(np.full(meta.size, 0.5))
    row, at, x = np.concatenate(rows), np.concatenate(index), np.concatenate(value).astype(np.float32)
    order = np.argsort(row, kind="stable")
    return row[order], at[order], x[order]


def _margin(m: Machine, row: np.ndarray, at: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The score before the logistic function, by the identity of the sum of squares. Every row has features."""
    first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    vx = m.v[at] * x[:, None]
    sums = np.add.reduceat(vx, first)
    squares = np.add.reduceat(vx * vx, first)
    return m.bias + np.add.reduceat(m.w[at] * x, first) + 0.5 * (sums * sums - squares).sum(axis=1), vx, sums


def fit(f: Features, label: np.ndarray, meta: np.ndarray | None = None, steps: int = STEPS, seed: int = 7) -> Machine:
    n = len(label)
    rng = np.random.default_rng(seed)
    m = Machine(0.0, np.zeros(_SIZE, np.float32), np.zeros((_SIZE, RANK), np.float32), np.zeros(_N), np.ones(_N), np.zeros((_N, BINS - 1)))
    if not n:
        return m
    m.mean, m.scale = f.stats.mean(axis=0), np.maximum(f.stats.std(axis=0), 1e-6)
    m.edges = np.quantile(f.stats, np.arange(1, BINS) / BINS, axis=0).T.copy()
    m.bias = float(np.log((label.sum() + 0.5) / (n - label.sum() + 0.5)))
    m.v = (rng.standard_normal((_SIZE, RANK)) * 0.05).astype(np.float32)
    blocks = [_Block(*_vector(m, _rows(f, i, min(i + FIT_ROWS, n)), None if meta is None else meta[i : i + FIT_ROWS])) for i in range(0, n, FIT_ROWS)]
    used = np.unique(np.concatenate([b.used for b in blocks]))
    for b in blocks:
        b.place = np.searchsorted(used, b.used)
    moments = [np.zeros((len(used), RANK + 1), np.float32), np.zeros((len(used), RANK + 1), np.float32)]
    bias_moments = [0.0, 0.0]
    for step in range(1, steps + 1):
        now = np.concatenate([m.w[used, None], m.v[used]], axis=1)
        grad, g = DECAY * now / n, 0.0
        for k, b in enumerate(blocks):
            z, vx, sums = _margin(m, b.row, b.at, b.x)
            error = ((1 / (1 + np.exp(-np.clip(z, -30, 30)))) - label[k * FIT_ROWS : k * FIT_ROWS + len(z)]).astype(np.float32) / n
            each = np.empty((len(b.at), RANK + 1), np.float32)
            each[:, 0] = error[b.row] * b.x
            each[:, 1:] = each[:, :1] * (sums[b.row] - vx)
            grad[b.place] += np.add.reduceat(each[b.by], b.cut)
            g += float(error.sum())
        moments[0] = 0.9 * moments[0] + 0.1 * grad
        moments[1] = 0.99 * moments[1] + 0.01 * grad * grad
        rate = RATE * (1 - 0.9 * step / steps)
        now -= rate * (moments[0] / (1 - 0.9**step)) / (np.sqrt(moments[1] / (1 - 0.99**step)) + 1e-8)
        m.w[used], m.v[used] = now[:, 0], now[:, 1:]
        bias_moments = [0.9 * bias_moments[0] + 0.1 * g, 0.99 * bias_moments[1] + 0.01 * g * g]
        m.bias -= rate * (bias_moments[0] / (1 - 0.9**step)) / (bias_moments[1] ** 0.5 / (1 - 0.99**step) ** 0.5 + 1e-8)
    return m


class _Block:
    """The features of a few training rows, and their order by feature."""

    def __init__(self, row: np.ndarray, at: np.ndarray, x: np.ndarray):
        self.row, self.at, self.x = row.astype(np.int32), at.astype(np.int32), x
        self.by = np.argsort(at, kind="stable").astype(np.int32)
        own = at[self.by]
        self.cut = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        self.used = own[self.cut]
        self.place = self.used


def _rows(f: Features, i: int, j: int) -> Features:
    a, b = np.searchsorted(f.row, [i, j])
    return Features(f.stats[i:j], f.row[a:b] - i, f.bucket[a:b], f.weight[a:b])


def score(m: Machine, data: np.ndarray, offsets: np.ndarray, meta: np.ndarray | None = None) -> np.ndarray:
    z, _, _ = _margin(m, *_vector(m, features(data, offsets), meta))
    return 1 / (1 + np.exp(-np.clip(z, -30, 30).astype(np.float64)))


def _meta(part: pa.RecordBatch, columns: list[str]) -> np.ndarray | None:
    import zlib

    if not columns:
        return None
    return np.array([[zlib.crc32(f"{c}={v}".encode()) % _META for v in part.column(c).to_pylist()] for c in columns], np.int64).T


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 5, is 0; false for a null id."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", metadata: list[str] | None = None, max_rows: int = TRAIN_ROWS, max_bytes: int = TRAIN_BYTES) -> Machine:
    """Fits on the labelled rows that aren't held out."""
    metadata = metadata or []

    def run(batches):
        for batch in batches:
            for part, data, offsets in text_slices(batch, "text"):
                f = features(data, offsets)
                at = np.searchsorted(f.row, np.arange(part.num_rows + 1))
                raw = lambda v, kind: [v[i:j].astype(kind).tobytes() for i, j in zip(at[:-1], at[1:])]
                bucket, weight, stats = raw(f.bucket, "<u2"), raw(f.weight, "<f4"), [s.astype("<f8").tobytes() for s in f.stats]
                meta = _meta(part, metadata)
                own = [b""] * part.num_rows if meta is None else [r.astype("<i8").tobytes() for r in meta]
                size = [len(b) + len(w) + len(s) for b, w, s in zip(bucket, weight, stats)]
                made = [pa.array(size, pa.int64()), *(pa.array(v, pa.binary()) for v in (bucket, weight, stats, own))]
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("y"), part.column("digest"), *made], names=["id", "y", "digest", "n_bytes", "bucket", "weight", "stats", "meta"])

    got = labelled_rows(docs, labels, label_col, held_out, run, "bucket binary, weight binary, stats binary, meta binary", metadata, max_rows, max_bytes)
    flat = lambda name, kind: np.frombuffer(b"".join(r[name] for r in got), kind)
    size = np.array([len(r.bucket) // 2 for r in got], np.int64)
    f = Features(flat("stats", "<f8").reshape(-1, _N), np.repeat(np.arange(len(got)), size), flat("bucket", "<u2").astype(np.int64), flat("weight", "<f4"))
    return fit(f, np.array([r.y for r in got], np.float32), flat("meta", "<i8").reshape(len(got), -1) if metadata else None)


def classify(docs: DataFrame, machine: Machine, metadata: list[str] | None = None, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """Adds score and predicted to every row."""
    metadata = metadata or []
    kept = [c for c in docs.columns if c.lower() not in ("score", "predicted")]
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches):
        for batch in batches:
            for part, data, offsets in text_slices(batch, text_col):
                s = score(shared.value, data, offsets, _meta(part, metadata))
                yield pa.RecordBatch.from_arrays([part.column(c) for c in kept] + [pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=[*kept, "score", "predicted"])

    schema = StructType([docs.schema[c] for c in kept] + [StructField("score", DoubleType()), StructField("predicted", IntegerType())])
    return docs.select(*[f"`{c}`" for c in kept]).mapInArrow(run, schema)


def keep_good(docs: DataFrame, machine: Machine, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose text scores at least the threshold, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches):
        for batch in batches:
            for part, data, offsets in text_slices(batch, "text"):
                yield part.filter(pa.array(score(shared.value, data, offsets) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def judge(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs(doc_id, text); neither metadata nor ids are inputs."""
    docs = docs.select("doc_id", "text")
    out = classify(docs, train(docs, labels), threshold=threshold)
    return out.select("doc_id", held_out(F.col("doc_id")).cast(BooleanType()).alias("held_out"), "score", "predicted")
