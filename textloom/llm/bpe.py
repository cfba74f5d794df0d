"""Byte-level BPE encoding and decoding on length-bucketed padded numpy matrices.

The ranks of a tiktoken file define the merges. Texts are cut by the public pattern; every distinct piece is
encoded once per worker (a cache bounded by its pieces and ids keeps them). Pieces of like length form one padded matrix; in every
round each row looks its adjacent pairs up in a hashed pair table, merges its leftmost pair of least rank and is
compacted by one column; rows without a pair left leave the matrix. A piece longer than MATRIX_BYTES is a matrix of one row,
which merges all places of its least pair in one round, leftmost first, unless one of these merges makes a pair of
lower rank: then the leftmost alone. So its rounds are at most as many as the ranks that it uses, and the ids are those of one merge at a time.

Nulls in the text column count as empty texts: no ids. Null ids of rows, repeated rows and an empty table give the like in the result; a
text of any length is cut whole, in one Python step. Other columns are
kept as they are, and of clashing names (n_tokens, ids, decoded ...) the operator's column wins.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import text_slices

#: Longest piece that shares a padded matrix with others.
MATRIX_BYTES = 128
#: Distinct pieces whose ids a worker keeps, and ids of all of them.
CACHE_PIECES, CACHE_IDS = 60_000, 1_000_000
_NONE = np.int32(2**31 - 1)
_U = np.uint64


class Codec:
    """Ranks, the hashed pair table and the piece cache of one worker."""

    def __init__(self, path: str, pattern: str):
        import regex

        with open(path, "rb") as f:
            pairs = (line.split() for line in f if line.strip())
            self.ranks = {base64.b64decode(a): int(b) for a, b in pairs}
        self.tokens = {i: t for t, i in self.ranks.items()}
        self.find = regex.compile(pattern).findall
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        left, right, made = [], [], []
        for token, rank in self.ranks.items():
            for k in range(1, len(token)):
                a, b = self.ranks.get(token[:k]), self.ranks.get(token[k:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    made.append(rank)
        self._build(np.array(left, np.int64), np.array(right, np.int64), np.array(made, np.int32))
        self.forget()

    def forget(self) -> None:
        self.cache: dict[str, int] = {}
        self.flat: list[np.ndarray] = []
        self.lens = np.zeros(0, np.int64)
        self.starts = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int32)

    def _build(self, left: np.ndarray, right: np.ndarray, made: np.ndarray) -> None:
        """An open-addressing table with linear probes, at most a quarter full."""
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(left)) * 4))))
        size = 1 << self.bits
        self.keys, self.values = np.full(size, -1, np.int64), np.full(size, _NONE, np.int32)
        todo, slot = (left << 32) | right, self._slot((left << 32) | right)
        self.probes = 0
        while len(todo):
            self.probes += 1
            free = np.flatnonzero(self.keys[slot] == -1)
            _, first = np.unique(slot[free], return_index=True)
            take = free[first]
            self.keys[slot[take]] = todo[take]
            self.values[slot[take]] = made[take]
            stay = np.ones(len(todo), bool)
            stay[take] = False
            todo, made, slot = todo[stay], made[stay], (slot[stay] + 1) & (size - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * _U(0x9E3779B97F4A7C15)) >> _U(64 - self.bits)).astype(np.int64)

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each merged pair, which is also the new id; _NONE where the pair doesn't merge."""
        key = (a.astype(np.int64) << 32) | b
        slot = self._slot(key)
        out = np.where(self.keys[slot] == key, self.values[slot], _NONE)
        open_ = np.flatnonzero((self.keys[slot] != key) & (self.keys[slot] != -1))
        for _ in range(self.probes):
            if not len(open_):
                break
            slot[open_] = (slot[open_] + 1) & (len(self.keys) - 1)
            at = self.keys[slot[open_]]
            hit = at == key[open_]
            out[open_[hit]] = self.values[slot[open_[hit]]]
            open_ = open_[~hit & (at != -1)]
        return out

    def _matrix(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of pieces of 1 to MATRIX_BYTES bytes and of like length."""
        lens = np.array([len(p) for p in pieces], np.int64)
        width = int(lens.max())
        raw = np.zeros((len(pieces), width), np.int32)
        cols = np.arange(width)
        raw[cols < lens[:, None]] = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        out: list[np.ndarray | None] = [None] * len(pieces)
        rows = np.arange(len(pieces))
        while len(rows):
            width = raw.shape[1]
            ranks = np.full((len(rows), max(1, width - 1)), _NONE, np.int32)
            valid = cols[: width - 1] < (lens - 1)[:, None]
            ranks[:, : width - 1][valid] = self.pair_ranks(raw[:, :-1][valid], raw[:, 1:][valid])
            at = ranks.argmin(axis=1)  # the leftmost of the least
            best = ranks[np.arange(len(rows)), at]
            done = best == _NONE
            for i in np.flatnonzero(done):
                out[rows[i]] = raw[i, : lens[i]].copy()
            go = ~done
            raw, lens, rows, at, best = raw[go], lens[go], rows[go], at[go], best[go]
            if not len(rows):
                break
            raw[np.arange(len(rows)), at] = best
            keep = cols[:width] != (at + 1)[:, None]
            raw = raw[keep].reshape(len(rows), width - 1)
            lens = lens - 1
        return out  # type: ignore[return-value]

    def _row(self, piece: bytes) -> np.ndarray:
        """Ids of one long piece: a matrix of one row that merges all places of its least pair at once where that is safe."""
        ids = self.byte_ids[np.frombuffer(piece, np.uint8)]
        ranks = self.pair_ranks(ids[:-1], ids[1:])
        while len(ranks) and (least := ranks.min()) != _NONE:
            at = np.flatnonzero(ranks == least)
            if len(at) > 1:
                begins = np.concatenate([[True], np.diff(at) > 1])
                first = np.maximum.accumulate(np.where(begins, at, 0))
                at = at[(at - first) % 2 == 0]  # of places that overlap every other one, from the left
            if len(at) > 1:
                before, after = ids[at[at > 0] - 1], ids[at[at + 2 < len(ids)] + 2]
                made = lambda x: np.full(len(x), least, np.int32)
                lowest = min(self.pair_ranks(before, made(before)).min(initial=_NONE), self.pair_ranks(made(after), after).min(initial=_NONE))
                if (np.diff(at) == 2).any():
                    lowest = min(lowest, self.pair_ranks(made([0]), made([0]))[0])
                if lowest < least:
                    at = at[:1]
            ids[at] = least
            ids = np.delete(ids, at + 1)
            ranks = np.delete(ranks, at)
            near = at - np.arange(len(at))
            near = np.unique(np.concatenate([near - 1, near]))
            near = near[(near >= 0) & (near < len(ranks))]
            ranks[near] = self.pair_ranks(ids[near], ids[near + 1])
        return ids

    def encode_pieces(self, pieces: list[bytes]) -> list[np.ndarray]:
        out: list[np.ndarray] = [None] * len(pieces)  # type: ignore[list-item]
        buckets: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            n = len(p)
            if n > MATRIX_BYTES:
                out[i] = self._row(p)
            else:
                buckets.setdefault(n if n <= 16 else 16 + -(-(n - 16) // 8) * 8, []).append(i)
        for width, where in buckets.items():
            step = max(1, 400_000 // width)
            for k in range(0, len(where), step):
                part = where[k : k + step]
                for i, ids in zip(part, self._matrix([pieces[i] for i in part])):
                    out[i] = ids
        return out

    def encode_texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, end to end, and the offsets of the texts in them."""
        if len(self.cache) > CACHE_PIECES or len(self.ids) > CACHE_IDS:
            self.forget()
        cut = [self.find(t) for t in texts]
        cache = self.cache
        new = list(set().union(*cut).difference(cache)) if cut else []
        if new:
            coded = self.encode_pieces([p.encode() for p in new])
            cache.update(zip(new, range(len(cache), len(cache) + len(new))))
            lens = np.fromiter(map(len, coded), np.int64, len(coded))
            self.lens = np.concatenate([self.lens, lens])
            self.ids = np.concatenate([self.ids, *coded])
            self.starts = np.cumsum(self.lens) - self.lens
        counts = np.fromiter(map(len, cut), np.int64, len(cut))
        which = np.fromiter((cache[p] for c in cut for p in c), np.int64, int(counts.sum()))
        lens = self.lens[which]
        ends = np.cumsum(lens)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.ids[np.arange(total) + np.repeat(self.starts[which] - (ends - lens), lens)] if total else np.zeros(0, np.int32)
        offsets = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
        return ids, offsets

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """One codec for each vocabulary in each worker."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(path, pattern)
    return _codecs[path, pattern]


def _map(docs: DataFrame, text_col: str, added: str, make: Callable) -> DataFrame:
    from pyspark.sql.types import StructType, _parse_datatype_string

    new = _parse_datatype_string(added)
    names = {f.name.lower() for f in new}
    kept = [f.name for f in docs.schema if f.name.lower() not in names]
    schema = StructType([docs.schema[c] for c in kept] + list(new))

    def run(batches):
        for batch in batches:
            for part, data, offsets in text_slices(batch, text_col):
                raw = data.tobytes()
                texts = [raw[a:b].decode() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
                more = make(texts)
                yield pa.RecordBatch.from_arrays([part.column(c) for c in kept] + more, names=kept + [f.name for f in new])

    return docs.mapInArrow(run, schema)


def encode(docs: DataFrame, path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """Adds `ids array<int>`."""

    def make(texts):
        ids, offsets = codec(path, pattern).encode_texts(texts)
        return [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))]

    return _map(docs, text_col, "ids array<int>", make)


def decode(docs: DataFrame, path: str, pattern: str, ids_col: str = "ids") -> DataFrame:
    """Adds `decoded binary`, the bytes of the ids; null ids give null."""
    from pyspark.sql.types import BinaryType, StructField, StructType

    kept = [f.name for f in docs.schema if f.name.lower() != "decoded"]
    schema = StructType([docs.schema[c] for c in kept] + [StructField("decoded", BinaryType())])

    def run(batches):
        for batch in batches:
            own = codec(path, pattern)
            out = [None if v is None else own.decode(np.array(v, np.int64)) for v in batch.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + [pa.array(out, pa.binary())], names=[*kept, "decoded"])

    return docs.mapInArrow(run, schema)


def digests(docs: DataFrame, path: str, pattern: str, text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Encodes, decodes the ids again, and adds n_tokens, ids_sha256 and decoded_sha256; the ids stay in the worker unless kept."""

    def make(texts):
        own = codec(path, pattern)
        ids, offsets = own.encode_texts(texts)
        raw = ids.astype("<u4")
        sha = lambda b: hashlib.sha256(b).hexdigest()
        spans = list(zip(offsets[:-1].tolist(), offsets[1:].tolist()))
        out = [
            pa.array(np.diff(offsets), pa.int64()),
            pa.array([sha(raw[a:b].tobytes()) for a, b in spans], pa.string()),
            pa.array([sha(own.decode(ids[a:b])) for a, b in spans], pa.string()),
        ]
        return out + ([pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))] if keep_ids else [])

    return _map(docs, text_col, "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids, make)
