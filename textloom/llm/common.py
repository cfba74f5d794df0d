"""Shared helpers: reading tables, writing intermediate tables, slicing Arrow batches, hashing words."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..sources.staging import discard, settle, shared_dir  # noqa: F401

#: Bytes of text that one Python step holds in numpy arrays at a time.
CHUNK_BYTES = 1 << 19

_U = np.uint64


#: Bytes of an Arrow batch on its way to or from Python; the default is 64 MB for each task on either side.
ARROW_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder. Sets the session's Arrow batches to ARROW_BYTES, which bounds what a Python step holds."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_slices(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of a batch of about `limit` text bytes: (slice, its UTF-8 bytes, offsets of its rows). Null texts have no bytes."""
    import pyarrow.compute as pc

    if not batch.num_rows:
        return
    texts = pc.fill_null(batch.column(column), "").cast(pa.large_binary())
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], dtype=np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    start = 0
    while start < len(texts):
        end = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
        end = min(max(end, start + 1), len(texts))
        yield batch.slice(start, end - start), data[offsets[start] : offsets[end]], offsets[start : end + 1] - offsets[start]
        start = end
    release()


_libc = ctypes.CDLL(None)


def release() -> None:
    """Gives freed memory back to the system: workers live on after their tasks and would keep it."""
    pa.default_memory_pool().release_unused()
    if hasattr(_libc, "malloc_trim"):
        _libc.malloc_trim(0)


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> _U(27))
    h = h * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


_PIECE = 1 << 18
_BASE = 0x9E3779B97F4A7C15 | 1


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, dtype=np.uint64)
    out[1:] = _U(base)
    return np.multiply.accumulate(out)


class _Tables:
    """Made once in each Python worker."""

    ready = False

    @classmethod
    def get(cls):
        if not cls.ready:
            cls.pow = _powers(_BASE, _PIECE + 1)
            cls.inv = _powers(pow(_BASE, -1, 1 << 64), _PIECE + 1)
            cls.byte = mix(np.arange(1, 257, dtype=np.uint64) * _U(0xD6E8FEB86659FD93))
            low = np.arange(256, dtype=np.uint8)
            low[65:91] += 32
            cls.lower = low
            sep = np.zeros(256, dtype=bool)
            sep[[0x20, *range(0x09, 0x0E)]] = True
            cls.sep = sep
            cls.ready = True
        return cls


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words (runs of bytes other than space, tab, LF, VT, FF, CR) of texts laid end to end in `data`.

    Returns their starts, their ends and a 64-bit hash of each (A-Z lower-cased if `lower`). A word never
    crosses an offset.
    """
    t = _Tables.get()
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, np.uint64)
    sep = t.sep[data]
    inside = ~sep
    begin = inside.copy()
    begin[1:] &= sep[:-1]
    bounds = offsets[:-1][offsets[:-1] < len(data)]
    begin[bounds] |= inside[bounds]
    starts = np.flatnonzero(begin)
    stop = inside.copy()
    stop[:-1] &= sep[1:] | begin[1:]
    ends = np.flatnonzero(stop) + 1
    return starts, ends, span_hashes(t.lower[data] if lower else data, starts, ends)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span data[start:end]; spans are sorted and don't overlap."""
    t = _Tables.get()
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        at = starts[i]
        j = int(np.searchsorted(ends, at + _PIECE, side="right"))
        if j <= i:  # one span longer than a piece
            h = _U(0)
            for p in range(int(at), int(ends[i]), _PIECE):
                part = data[p : min(p + _PIECE, int(ends[i]))]
                h = h * _U(0x2545F4914F6CDD1D) + np.sum(t.byte[part] * t.pow[: len(part)], dtype=np.uint64)
            out[i] = h
            i += 1
            continue
        part = data[at : ends[j - 1]]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(t.byte[part] * t.pow[: len(part)], out=sums[1:])
        s, e = starts[i:j] - at, ends[i:j] - at
        out[i:j] = (sums[e] - sums[s]) * t.inv[s]
        i = j
    return mix(out + (ends - starts).astype(np.uint64) * _U(0xA0761D6478BD642F))


def rows_of(starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The row of each start."""
    return np.searchsorted(offsets, starts, side="right") - 1
