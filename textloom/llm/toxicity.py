"""Toxicity: a convolutional classifier of texts over hashed word embeddings, trained in numpy.

A word is a run of ASCII letters, digits and bytes from 0x80, A-Z lower-cased. Its vector is the sum of three hashed embeddings: of the
whole word and of its first bytes (PREFIXES), so that inflected and compound words are known by how they begin. Filters of
WIDTHS words slide over the text, each keeps its largest activation if that is positive, and a logistic unit weighs them. Behind the last word
stand zeros, so a text shorter than a filter has a window too.

The net is fitted by Adam on every labelled row that isn't held out; only the windows that win the pooling have gradients. It starts on the driver with at
most TRAIN_ROWS of them, of TRAIN_BYTES in all (see sample.py). If there are more, RATES rounds follow over all: each of at most PARTS tasks goes on from the
common net with its rows, and of each number the mean change of the tasks that changed it is added. Thresholds are calibrated by language on the same rows: a
net is fitted on either half of the ids in the same way and scores the other, and each language with at least MIN_POSITIVES toxic rows takes the cut of the
largest F1 (of scores counted to GRID if there are more rows than the start has); others take the overall one. The language is no input of the score, which `judge` compares with 0.3 as well.
A text of more than STRETCH bytes trains as stretches of its label; in the rounds over all rows repeated rows count each.

Null texts count as empty and have a score; without labels of both kinds every score is the share of toxic labels (0.5 without any). A null language takes the overall
threshold. Other columns stay in `classify`, and of clashing names the operator's wins; repeated rows get equal scores; an empty
table gives an empty result. Texts of any length are scored whole, long ones in stretches of STRETCH bytes that overlap so that no window is lost.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, StructField, StructType

from ..functions.bitmaps import among
from .common import _Tables, discard, rows_of, settle, span_hashes, text_slices
from .sample import labelled_rows

WORD_BITS, PREFIX_BITS, PREFIXES = 15, 13, (4, 7)
SIZE, WIDTHS, FILTERS = 16, (1, 2, 3), 16
#: Labelled rows, and bytes of their encoded words, that are collected for fitting, at most.
TRAIN_ROWS, TRAIN_BYTES = 4_000, 48 << 20
EPOCHS, BATCH, RATE, DECAY, SEED = 6, 32, 0.01, 1e-4, 5
THRESHOLD, MIN_POSITIVES = 0.3, 20
#: Rates of the rounds over all labelled rows, tasks of a round, steps of the scores that are counted, and pieces in which a net is summed.
RATES, PARTS, GRID, PIECES = (0.003, 0.001), 32, 1e-5, 16
STRETCH = 1 << 20
#: Words whose activations are held at a time.
STEP = 1 << 15

_U = np.uint64
_PAD = (1 << WORD_BITS) + len(PREFIXES) * (1 << PREFIX_BITS)
_REACH = max(WIDTHS) - 1
_GAP = np.ones(256, bool)
_GAP[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def encode(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The row of each word of texts laid end to end, and the buckets (words, 1 + prefixes) of its embeddings."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros((0, 1 + len(PREFIXES)), np.uint16)
    inside = ~_GAP[data]
    begin, stop = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    bounds = offsets[:-1][offsets[:-1] < len(data)]
    begin[bounds] |= inside[bounds]
    stop[:-1] &= ~inside[1:] | begin[1:]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    lower = _Tables.get().lower[data]
    out = np.empty((len(starts), 1 + len(PREFIXES)), np.uint16)
    out[:, 0] = span_hashes(lower, starts, ends) >> _U(64 - WORD_BITS)
    for k, n in enumerate(PREFIXES):
        own = span_hashes(lower, starts, np.minimum(ends, starts + n)) >> _U(64 - PREFIX_BITS)
        out[:, k + 1] = own + _U((1 << WORD_BITS) + k * (1 << PREFIX_BITS))
    return rows_of(starts, offsets), out


@dataclass
class Net:
    embed: np.ndarray  # (_PAD + 1, SIZE); the last row is 0
    kernels: list[np.ndarray]  # of each width: (width, SIZE, FILTERS)
    bias: np.ndarray  # of all filters
    out: np.ndarray
    base: float
    cuts: dict[str, float] = field(default_factory=dict)
    cut: float = THRESHOLD


def empty_net(base: float = 0.0, seed: int = SEED) -> Net:
    r = np.random.default_rng(seed)
    n = len(WIDTHS) * FILTERS
    embed = (r.standard_normal((_PAD + 1, SIZE)) * 0.02).astype(np.float32)
    embed[_PAD] = 0
    kernels = [(r.standard_normal((w, SIZE, FILTERS)) / (SIZE * w) ** 0.5).astype(np.float32) for w in WIDTHS]
    return Net(embed, kernels, np.zeros(n, np.float32), np.abs(r.standard_normal(n) * 0.1).astype(np.float32), base)


def vectors(net: Net, buckets: np.ndarray) -> np.ndarray:
    x = net.embed[buckets[:, 0]].copy()
    for k in range(1, buckets.shape[1]):
        x += net.embed[buckets[:, k]]
    return x


def activations(net: Net, x: np.ndarray) -> np.ndarray:
    """Of every filter at every word that has _REACH words behind it."""
    n = len(x) - _REACH
    return np.concatenate([sum(x[j : j + n] @ k[j] for j in range(w)) for w, k in zip(WIDTHS, net.kernels)], axis=1)


def laid_out(row: np.ndarray, buckets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of n rows with _REACH empty words behind each (and one in a row without words), and the bounds of the rows' windows in them."""
    size = np.bincount(row, minlength=n)
    room = np.maximum(size, 1)
    first = np.cumsum(room + _REACH) - (room + _REACH)
    out = np.full((int((room + _REACH).sum()), buckets.shape[1]), _PAD, np.uint16)
    out[np.arange(len(row)) - (np.cumsum(size) - size)[row] + first[row]] = buckets
    return out, np.stack([first, first + room])


def pooled(net: Net, row: np.ndarray, buckets: np.ndarray, n: int) -> np.ndarray:
    """The largest activation of every filter in each of n rows."""
    laid, (first, last) = laid_out(row, buckets, n)
    return _largest(net, laid, first, last)


def _largest(net: Net, laid: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    out = np.full((len(first), len(net.bias)), -np.inf, np.float32)
    at = 0
    while at < len(laid) - _REACH:
        stop = min(at + STEP, len(laid) - _REACH)
        act = activations(net, vectors(net, laid[at : stop + _REACH]))
        rows = np.arange(np.searchsorted(last, at, side="right"), np.searchsorted(first, stop))
        a, b = np.maximum(first[rows], at) - at, np.minimum(last[rows], stop) - at
        if len(rows):
            marks = np.stack([a, b], axis=1).ravel()
            tail = marks[-1] == len(act)
            best = np.maximum.reduceat(act, marks[:-1] if tail else marks, axis=0)[::2]
            out[rows] = np.maximum(out[rows], best)
        at = stop
    return out


def _margin(net: Net, best: np.ndarray) -> np.ndarray:
    return net.base + np.maximum(best + net.bias, 0) @ net.out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -30, 30)))


def score(net: Net, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    if len(offsets) == 2 and len(data) > STRETCH:
        return _sigmoid(_margin(net, _long(net, data)[None]))
    return _sigmoid(_margin(net, pooled(net, *encode(data, offsets), len(offsets) - 1)))


def _long(net: Net, data: np.ndarray, size: int = STRETCH) -> np.ndarray:
    """pooled() of one long text, a stretch at a time; the last _REACH words of one begin the next."""
    best, held, at = np.full(len(net.bias), -np.inf, np.float32), np.zeros((0, 1 + len(PREFIXES)), np.uint16), 0
    while at < len(data):
        stop = min(at + size, len(data))
        while stop < len(data) and not _GAP[data[stop]]:
            ahead = np.flatnonzero(_GAP[data[stop : stop + size]])
            stop = stop + int(ahead[0]) if len(ahead) else min(stop + size, len(data))
        _, own = encode(data[at:stop], np.array([0, stop - at], np.int64))
        own = np.concatenate([held, own])
        if stop < len(data) and len(own) > _REACH:
            best = np.maximum(best, _largest(net, own, np.array([0]), np.array([len(own) - _REACH]))[0])
            own = own[-_REACH:] if _REACH else own[:0]
        held, at = own, stop
    return np.maximum(best, pooled(net, np.zeros(len(held), np.int64), held, 1)[0])


@dataclass
class Rows:
    """Training rows: the buckets of their words laid end to end, and the bounds of the rows."""

    buckets: np.ndarray
    bounds: np.ndarray
    label: np.ndarray

    def some(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        parts = [self.buckets[self.bounds[i] : self.bounds[i + 1]] for i in which]
        return np.repeat(np.arange(len(which)), [len(p) for p in parts]), np.concatenate(parts) if len(parts) else self.buckets[:0]


class _Adam:
    """Adam on one array; on a table's rows, those that have a gradient."""

    def __init__(self, value: np.ndarray):
        self.m, self.v, self.t = np.zeros_like(value), np.zeros_like(value), 0

    def step(self, value: np.ndarray, grad: np.ndarray, rate: float, rows: np.ndarray | slice = slice(None)) -> None:
        self.t += 1
        m = self.m[rows] = 0.9 * self.m[rows] + 0.1 * grad
        v = self.v[rows] = 0.99 * self.v[rows] + 0.01 * grad * grad
        value[rows] -= (rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.99**self.t)) + 1e-8)).astype(np.float32)


class _Trainer:
    """A net and the state of its Adam."""

    def __init__(self, net: Net):
        self.net = net
        self.embed, self.kernels, self.bias, self.out, self.base = _Adam(net.embed), [_Adam(k) for k in net.kernels], _Adam(net.bias), _Adam(net.out), _Adam(np.zeros(1))

    def step(self, rows: Rows, own: np.ndarray, rate: float) -> None:
        net = self.net
        laid, (first, last) = laid_out(*rows.some(own), len(own))
        x = vectors(net, laid)
        act = activations(net, x)
        at = np.stack([a + act[a:b].argmax(axis=0) for a, b in zip(first, last)])  # (rows, filters)
        best = np.take_along_axis(act, at, axis=0) + net.bias
        fired = np.maximum(best, 0)
        z = net.base + fired @ net.out
        error = ((_sigmoid(z) - rows.label[own]) / len(own)).astype(np.float32)
        g = error[:, None] * net.out * (best > 0)
        touched, grads = [], []
        for k, w in enumerate(WIDTHS):
            f = slice(k * FILTERS, (k + 1) * FILTERS)
            gk, grad = g[:, f], np.empty_like(net.kernels[k])
            for j in range(w):
                place = at[:, f] + j
                grad[j] = np.einsum("rf,rfe->ef", gk, x[place]) + DECAY * net.kernels[k][j]
                back = gk[:, :, None] * net.kernels[k][j].T[None]
                live = gk != 0
                touched.append(laid[place[live]])
                grads.append(back[live])
            self.kernels[k].step(net.kernels[k], grad, rate)
        rowwise, each = np.concatenate(touched), np.concatenate(grads)
        ids, place = np.unique(rowwise, return_inverse=True)
        total = np.zeros((len(ids), SIZE), np.float32)
        place = place.reshape(rowwise.shape)
        for c in range(rowwise.shape[1]):
            np.add.at(total, place[:, c], each)
        seen = ids != _PAD
        if seen.any():
            self.embed.step(net.embed, total[seen] + DECAY * net.embed[ids[seen]], rate, ids[seen])
        self.out.step(net.out, error @ fired + DECAY * net.out, rate)
        self.bias.step(net.bias, g.sum(axis=0), rate)
        now = np.array([net.base])
        self.base.step(now, np.array([error.sum()]), rate)
        net.base = float(now[0])


def fit(rows: Rows, which: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> Net:
    label = rows.label[which]
    share = (label.sum() + 0.5) / (len(label) + 1)
    net = empty_net(float(np.log(share / (1 - share))), seed)
    if not len(which) or label.min() == label.max():
        net.out[:] = 0
        return net
    r = np.random.default_rng(seed)
    trainer, steps, step = _Trainer(net), epochs * -(-len(which) // BATCH), 0
    for _ in range(epochs):
        order = r.permutation(which)
        for i in range(0, len(order), BATCH):
            trainer.step(rows, order[i : i + BATCH], RATE * (1 - 0.9 * step / steps))
            step += 1
    return net


def best_cut(scores: np.ndarray, label: np.ndarray) -> float:
    """The midpoint below the lowest score taken, of the largest F1; the highest of equals."""
    order = np.argsort(-scores, kind="stable")
    s, hits = scores[order], np.cumsum(label[order])
    f1 = 2 * hits / (np.arange(1, len(s) + 1) + label.sum())
    ends = np.append(s[1:] < s[:-1], True)
    k = int(np.argmax(np.where(ends, f1, -1)))
    return float((s[k] + s[k + 1]) / 2) if k + 1 < len(s) else float(s[k] / 2)


def best_cut_of_counts(scores: np.ndarray, hits: np.ndarray, of: np.ndarray) -> float:
    """best_cut() of distinct scores, with the toxic rows and all rows of each."""
    order = np.argsort(-scores)
    s, hits, of = scores[order], np.cumsum(hits[order]), np.cumsum(of[order])
    k = int(np.argmax(2 * hits / (of + hits[-1])))
    return float((s[k] + s[k + 1]) / 2) if k + 1 < len(s) else float(s[k] / 2)


def _flat(net: Net) -> np.ndarray:
    return np.concatenate([net.embed.ravel(), *(k.ravel() for k in net.kernels), net.bias, net.out, [net.base]]).astype(np.float64)


def _put(net: Net, flat: np.ndarray) -> Net:
    made, at = [], 0
    for a in (net.embed, *net.kernels, net.bias, net.out):
        made.append(flat[at : at + a.size].reshape(a.shape).astype(np.float32))
        at += a.size
    return Net(made[0], made[1:-2], made[-2], made[-1], float(flat[-1]))


def _half(ids: list[int]) -> np.ndarray:
    """0 or 1 of each id."""
    return np.array([zlib.crc32(str(i).encode()) >> 2 & 1 for i in ids], np.int64)


def _labelled(docs: DataFrame, labels: DataFrame, label_col: str) -> DataFrame:
    """id, y, text, lang of all rows that are trained on. Texts without a label are dropped by a bitmap of the labelled ids and aren't shuffled."""
    known = labels.where(F.col(label_col).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.select(F.col("doc_id").cast("long").alias("id"), F.col(label_col).cast("int").alias("y")).distinct()
    own = docs.select(F.col("doc_id").cast("long").alias("id"), "text", "lang").where("id is not null")
    return among(own, F.col("id"), known.select("id"), known.count()).join(known.hint("merge"), "id").select("id", "y", "text", "lang")


def _round(rows: DataFrame, nets: list[Net], rate: float) -> list[Net]:
    """The nets after a pass over all rows: the first one over every row, the next two over a half of the ids each."""
    shared = rows.sparkSession.sparkContext.broadcast(nets)

    def run(batches):
        trainers = [_Trainer(_put(n, _flat(n))) for n in shared.value]
        r = np.random.default_rng(SEED)
        for batch in batches:
            for part, data, offsets in text_slices(batch, "text"):
                label, half = np.asarray(part.column("y"), np.float32), _half(part.column("id").to_pylist())
                cut = range(0, len(data), STRETCH) if part.num_rows == 1 and len(data) > STRETCH else (None,)
                for at in cut:
                    own, ends = (data, offsets) if at is None else (data[at : at + STRETCH], np.array([0, min(STRETCH, len(data) - at)], np.int64))
                    row, buckets = encode(own, ends)
                    held = Rows(buckets, np.searchsorted(row, np.arange(len(ends))), label)
                    for which, trainer in zip((None, 0, 1), trainers):
                        order = r.permutation(np.arange(len(label)) if which is None else np.flatnonzero(half == which))
                        for i in range(0, len(order), BATCH):
                            trainer.step(held, order[i : i + BATCH], rate)
        for k, (net, trainer) in enumerate(zip(shared.value, trainers)):
            moved = np.array_split((_flat(trainer.net) - _flat(net)).astype(np.float32), PIECES)
            yield pa.RecordBatch.from_arrays([pa.array([k] * PIECES, pa.int32()), pa.array(range(PIECES), pa.int32()), pa.array([m.tobytes() for m in moved])], names=["net", "piece", "moved"])

    def mean(key, part):
        each = np.stack([np.frombuffer(m, np.float32) for m in sorted(part.column("moved").to_pylist())]).astype(np.float64)
        out = each.sum(axis=0) / np.maximum((each != 0).sum(axis=0), 1)
        return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([key[1].as_py()], pa.int32()), pa.array([out.tobytes()])], names=["net", "piece", "moved"])

    shape = "net int, piece int, moved binary"
    got = rows.coalesce(PARTS).mapInArrow(run, shape).groupBy("net", "piece").applyInArrow(mean, shape).collect()
    shared.destroy()
    pieces = {(x.net, x.piece): np.frombuffer(x.moved) for x in got}
    return [_put(n, _flat(n) + np.concatenate([pieces[k, i] for i in range(PIECES)])) for k, n in enumerate(nets)]


def _calibrated(rows: DataFrame, nets: list[Net]) -> Net:
    """The first net with cuts of the scores that each row has from the net of the other half."""
    shared = rows.sparkSession.sparkContext.broadcast(nets[1:])

    def run(batches):
        for batch in batches:
            for part, data, offsets in text_slices(batch, "text"):
                half = _half(part.column("id").to_pylist())
                fair = score(shared.value[1 - half[0]], data, offsets) if part.num_rows == 1 else _both(shared.value, data, offsets, half)
                yield pa.RecordBatch.from_arrays([part.column("lang"), part.column("y"), pa.array(np.round(fair / GRID).astype(np.int32))], names=["lang", "y", "place"])

    counted = rows.mapInArrow(run, "lang string, y int, place int").groupBy("lang", "place").agg(F.sum("y").alias("hits"), F.count(F.lit(1)).alias("n"))
    enough = counted.groupBy("lang").agg(F.sum("hits").alias("all")).where(f"lang is not null and all >= {MIN_POSITIVES}").select("lang")
    by_lang = counted.join(enough, "lang", "left_semi").unionByName(counted.groupBy("place").agg(F.sum("hits").alias("hits"), F.sum("n").alias("n")).selectExpr("string(null) as lang", "place", "hits", "n"))
    got = by_lang.toArrow().to_pandas()  # as many rows as languages have steps, at most
    shared.destroy()
    for lang, own in got.groupby("lang", dropna=False):
        cut = best_cut_of_counts(own["place"].to_numpy() * GRID, own["hits"].to_numpy(), own["n"].to_numpy())
        if isinstance(lang, str):
            nets[0].cuts[lang] = cut
        else:
            nets[0].cut = cut
    return nets[0]


def _both(nets: list[Net], data: np.ndarray, offsets: np.ndarray, half: np.ndarray) -> np.ndarray:
    """Of each row the score by the net of the other half."""
    row, buckets = encode(data, offsets)
    held, out = Rows(buckets, np.searchsorted(row, np.arange(len(offsets))), half), np.zeros(len(half))
    for k, net in enumerate(nets):
        which = np.flatnonzero(half != k)
        if len(which):
            out[which] = _sigmoid(_margin(net, pooled(net, *held.some(which), len(which))))
    return out


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", max_rows: int = TRAIN_ROWS, max_bytes: int = TRAIN_BYTES) -> Net:
    """Fits and calibrates on the labelled rows of docs(doc_id, text, lang) that aren't held out."""
    if "lang" not in docs.columns:
        docs = docs.withColumn("lang", F.lit(None).cast("string"))

    def run(batches):
        for batch in batches:
            for part, data, offsets in text_slices(batch, "text"):
                row, buckets = encode(data, offsets)
                at = np.searchsorted(row, np.arange(part.num_rows + 1))
                raw = [buckets[a:b].tobytes() for a, b in zip(at[:-1], at[1:])]
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("y"), part.column("digest"), pa.array([len(x) for x in raw], pa.int64()), part.column("lang"), pa.array(raw, pa.binary())], names=["id", "y", "digest", "n_bytes", "lang", "buckets"])

    got = labelled_rows(docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang")), labels, label_col, held_out, run, "lang string, buckets binary", ["lang"], max_rows, max_bytes)
    width = 1 + len(PREFIXES)
    rows = Rows(np.frombuffer(b"".join(r.buckets for r in got), np.uint16).reshape(-1, width), np.concatenate([[0], np.cumsum([len(r.buckets) // (2 * width) for r in got])]).astype(np.int64), np.array([r.y for r in got], np.float32))
    every = np.arange(len(got))
    net = fit(rows, every)
    whole = _labelled(docs, labels, label_col)
    more = whole.count() > len(got)
    if not more and (not len(got) or rows.label.min() == rows.label.max()):
        return net
    fair, halves, nets = np.zeros(len(got)), _half([r.id for r in got]), [net]
    for k in (0, 1):
        half, other = every[halves == k], every[halves != k]
        own = fit(rows, half)
        nets.append(own)
        for i in range(0, 0 if more else len(other), 256):
            fair[other[i : i + 256]] = _sigmoid(_margin(own, pooled(own, *rows.some(other[i : i + 256]), len(other[i : i + 256]))))
    if more:
        whole = settle(whole, "toxic-rows")
        for rate in RATES:
            nets = _round(whole, nets, rate)
        net = _calibrated(whole, nets)
        discard(whole)
        return net
    net.cut = best_cut(fair, rows.label)
    langs = np.array([r.lang if r.lang is not None else "" for r in got], object)
    for lang in sorted({r.lang for r in got} - {None}):
        own = langs == lang
        if rows.label[own].sum() >= MIN_POSITIVES:
            net.cuts[lang] = best_cut(fair[own], rows.label[own])
    return net


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 4, is 2; false for a null id."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


def classify(docs: DataFrame, net: Net, text_col: str = "text", lang_col: str = "lang", threshold: float = THRESHOLD) -> DataFrame:
    """Adds score, predicted (score >= threshold), lang_threshold and flagged (score >= the language's threshold) to every row."""
    added = ("score", "predicted", "lang_threshold", "flagged")
    kept = [c for c in docs.columns if c.lower() not in added]
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches):
        for batch in batches:
            for part, data, offsets in text_slices(batch, text_col):
                s = score(shared.value, data, offsets)
                langs = part.column(lang_col).to_pylist() if lang_col in kept else [None] * part.num_rows
                cuts = np.array([shared.value.cuts.get(x, shared.value.cut) for x in langs], np.float64)
                made = [pa.array(s), pa.array((s >= threshold).astype(np.int32)), pa.array(cuts), pa.array(s >= cuts)]
                yield pa.RecordBatch.from_arrays([part.column(c) for c in kept] + made, names=[*kept, *added])

    kinds = (DoubleType(), IntegerType(), DoubleType(), BooleanType())
    schema = StructType([docs.schema[c] for c in kept] + [StructField(c, k) for c, k in zip(added, kinds)])
    return docs.select(*[f"`{c}`" for c in kept]).mapInArrow(run, schema)


def judge(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted, lang_threshold, flagged of every row of docs(doc_id, text, lang)."""
    own = docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang")) if "lang" in docs.columns else docs.select("doc_id", "text")
    out = classify(own, train(own, labels), threshold=threshold)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "lang_threshold", "flagged")
