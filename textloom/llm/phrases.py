"""Phrase collocations: a merged count-min sketch bounds every n-gram's count, a second pass counts the survivors exactly.

A-Z are lower-cased; BREAKS cut a text into pieces, spaces and tabs a piece into words; a phrase is up to MAX_WORDS words in a row
within a piece. All counts are per language (null: `und`). First each task sends the sorted cells of its n-grams, about a byte for each, and
Spark sums them block by block, clipped at min_count. A cell is never less than the count of any n-gram in it: what stays below
min_count can't be frequent, and neither can what holds such an n-gram; both are left out of the second pass, which counts all
others exactly, as strings, by a partial and a final aggregation. The sketch has a cell for each 0.8 * min_count bytes of text, so that a cell holds half of
min_count on the average, whatever the input's size; what is broadcast is one bit a cell, 2**MAX_BITS of them (128 MB) at most, and a task holds
CHUNK cells (64 MB) or a block. Beyond MAX_BITS (some 25 GB of text) more infrequent n-grams reach the second pass, and the result stays the same.

A candidate of 2 or more words with a >= min_count is cut after its first k words into parts of l and r occurrences and scores
floor(SCALE * a / (l + r)); its lowest cut counts, ties to the smallest k. Parts of a frequent phrase are frequent, so the counted ones suffice. A candidate
inside a longer candidate with at least `percent` of its count is subsumed. Arithmetic is in decimals. The `top` of each language come from partial rankings over salted
groups, so a language with most of the rows isn't sorted in one task.

Null texts are empty; texts without words give nothing; repeated rows count each time; ids play no part and extra columns don't reach the
result. An empty table gives an empty result. A very long text is worked on in stretches of STRETCH bytes: n-grams that begin in one may
end in the next, so none is lost or counted twice.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import _Tables, mix, rows_of, settle, span_hashes, text_slices

MIN_COUNT, MAX_WORDS, PERCENT, SCALE, TOP = 30, 4, 80, 2_000_000, 2_000
MIN_BITS, MAX_BITS, DEPTH = 16, 30, 1
STRETCH = 1 << 20
#: Cells that a task sorts and sends at a time, and cells of the sketch that are summed by one task at a time.
CHUNK, BLOCK = 1 << 24, 1 << 20
#: Sorted cells that are made into a row at a time, and bytes of rows in an Arrow batch.
PIECE, SENT = 1 << 18, 1 << 20
#: Groups into which a language's candidates are dealt before they are ranked.
SALTS = 64
UNKNOWN = "und"
BREAKS = b".,;:!?\n\x0b\x0c\r"

_U = np.uint64
_BREAK = np.zeros(256, bool)
_BREAK[list(BREAKS)] = True
_GAP = _BREAK.copy()
_GAP[list(b" \t")] = True
_AHEAD = rb"(?:[ \t]*[^ \t.,;:!?\n\x0b\x0c\r]+){0,%d}"


def stretches(data: np.ndarray, offsets: np.ndarray, max_words: int, size: int = STRETCH) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(bytes, offsets, bytes in which n-grams may begin): all at once, or a single long text behind its gaps, with the words that follow."""
    if len(offsets) != 2 or len(data) <= size:
        yield data, offsets, len(data)
        return
    ahead = re.compile(_AHEAD % (max_words - 1))
    raw, at = data.tobytes(), 0
    while at < len(raw):
        stop = min(at + size, len(raw))
        if stop < len(raw):
            gaps = np.flatnonzero(_GAP[data[at:stop]])
            if not len(gaps):  # a word longer than a stretch
                gaps, at_gap = [], stop
                while at_gap < len(raw) and not len(gaps):
                    gaps = np.flatnonzero(_GAP[data[at_gap : at_gap + size]])[:1] + (at_gap - at)
                    at_gap += size
            stop = at + int(gaps[-1]) + 1 if len(gaps) else len(raw)
        end = stop if _BREAK[raw[stop - 1]] else ahead.match(raw, stop).end()
        yield data[at:end], np.array([0, end - at], np.int64), stop - at
        at = stop


class Grams:
    """The n-grams of texts laid end to end: hash, check (a second hash), word (of the first word), size."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, limit: int, seeds: np.ndarray, max_words: int):
        lower = _Tables.get().lower[data]
        gap = _GAP[data]
        inside = ~gap
        begin, stop = inside.copy(), inside.copy()
        if len(data):
            begin[1:] &= gap[:-1]
            bounds = offsets[:-1][offsets[:-1] < len(data)]
            begin[bounds] |= inside[bounds]
            stop[:-1] &= gap[1:] | begin[1:]
        starts, ends = np.flatnonzero(begin), np.flatnonzero(stop) + 1
        row = rows_of(starts, offsets)
        n = len(starts)
        breaks = np.cumsum(_BREAK[data])[starts] if n else np.zeros(0, np.int64)
        tied = (breaks[1:] == breaks[:-1]) & (row[1:] == row[:-1])
        first = starts < limit
        own = span_hashes(lower, starts, ends)
        h, g, valid = mix(own ^ seeds[row]), own * _U(0x9E3779B97F4A7C15) + seeds[row], first
        hashes, checks, word, size = [], [], [], []
        for k in range(1, max_words + 1):
            if k > 1:
                m = n - k + 1
                if m <= 0:
                    break
                h = mix(h[:m] * _U(0xA24BAED4963EE407) + own[k - 1 :] + _U(k))
                g = (g[:m] ^ (g[:m] >> _U(29))) * _U(0xC2B2AE3D27D4EB4F) + own[k - 1 :]
                valid = valid[:m] & tied[k - 2 :]
            at = np.flatnonzero(valid)
            hashes.append(h[at])
            checks.append(g[at])
            word.append(at)
            size.append(np.full(len(at), k, np.int8))
        self.hash, self.check = np.concatenate(hashes), np.concatenate(checks)
        self.word, self.size = np.concatenate(word), np.concatenate(size)
        self.row, self.begun = row, first
        # the words, lower-cased, with one space behind each
        length = ends - starts
        self.places = np.concatenate([[0], np.cumsum(length + 1)])
        self.text = np.full(int(self.places[-1]), 32, np.uint8)
        self.text[np.arange(int(length.sum())) + np.repeat(np.arange(n), length)] = lower[inside]

    def strings(self, which: np.ndarray) -> pa.Array:
        a, b = self.places[self.word[which]], self.places[self.word[which] + self.size[which]] - 1
        length = b - a
        ends = np.concatenate([[0], np.cumsum(length)])
        at = np.arange(int(ends[-1])) + np.repeat(a - ends[:-1], length)
        return pa.Array.from_buffers(pa.large_string(), len(which), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(self.text[at])]).cast(pa.string())


def width(docs: DataFrame, min_count: int = MIN_COUNT) -> int:
    """The bits of a sketch whose cells hold about half of min_count n-grams."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return min(max(int(np.ceil(np.log2(max(size, 1) / (0.8 * min_count)))), MIN_BITS), MAX_BITS)


def columns(hashes: np.ndarray, bits: int, depth: int = DEPTH) -> list[np.ndarray]:
    """The column of each hash in each row of a sketch."""
    return [(mix(hashes + _U(0xD6E8FEB86659FD93 * d % (1 << 64))) >> _U(64 - bits)).astype(np.int64) for d in range(depth)]


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"), "text")


def _grams(batches, max_words: int) -> Iterator[tuple[Grams, pa.Array]]:
    for batch in batches:
        for part, data, offsets in text_slices(batch, "text", STRETCH):
            langs = part.column("lang").dictionary_encode()
            seeds = np.array([zlib.crc32(x.encode()) + 1 for x in langs.dictionary.to_pylist()], np.uint64)[np.asarray(langs.indices)]
            for own, bounds, limit in stretches(data, offsets, max_words):
                yield Grams(own, bounds, limit, mix(seeds), max_words), part.column("lang")


def _cell_type(min_count: int):
    return next(t for t in (np.uint8, np.uint16, np.uint32) if min_count <= np.iinfo(t).max)


def gaps(places: np.ndarray) -> bytes:
    """Sorted places as the gaps between them: a byte 255 for each 255 of a gap, and one for the rest."""
    times, rest = np.divmod(np.diff(places, prepend=places.dtype.type(0)), 255)
    ends = np.cumsum(times.astype(np.int64) + 1)
    out = np.full(int(ends[-1]) if len(ends) else 0, 255, np.uint8)
    out[ends - 1] = rest
    return out.tobytes()


def places(raw: bytes) -> np.ndarray:
    """What gaps() was given."""
    few = np.frombuffer(raw, np.uint8)
    return np.cumsum(few, dtype=np.int64)[few != 255]


def _sent(cells: np.ndarray, block: int, most: int) -> Iterator[pa.RecordBatch]:
    """The cells as rows of a block, each cell `most` times at most in a row. Sorts them in place and works on PIECE of them at a time."""
    cells.sort()
    of, raw, n, a = [], [], 0, 0
    made = lambda: pa.RecordBatch.from_arrays([pa.array(of, pa.int32()), pa.array(raw, pa.binary())], names=["block", "cells"])
    while a < len(cells):
        own = int(cells[a]) // block
        some = cells[a : a + PIECE]
        if int(some[-1]) // block != own:
            some = some[: np.searchsorted(some, cells.dtype.type((own + 1) * block))]
        a += len(some)
        fresh = np.ones(len(some), bool)
        fresh[most:] = some[most:] != some[:-most]
        of.append(own)
        raw.append(gaps(some[fresh] - cells.dtype.type(own * block)))
        n += len(raw[-1])
        if n >= SENT:
            yield made()
            of, raw, n = [], [], 0
    if of:
        yield made()


def _merged(docs: DataFrame, bits: int, min_count: int, max_words: int, depth: int, finish) -> Iterator[tuple[int, pa.Buffer]]:
    """(block, finish(its cells' counts, clipped at min_count)) of all blocks with n-grams."""
    kind, block, size = _cell_type(min_count), min(BLOCK, 1 << bits), CHUNK
    cell = np.uint32 if depth << bits <= 1 << 32 else np.uint64

    def count(batches):
        held, n = np.empty(size, cell), 0
        for grams, _ in _grams(batches, max_words):
            for d, at in enumerate(columns(grams.hash, bits, depth)):
                at = (at + (d << bits)).astype(cell)
                while len(at):
                    some = at[: size - n]
                    held[n : n + len(some)] = some
                    n, at = n + len(some), at[len(some) :]
                    if n == size:
                        yield from _sent(held, block, min_count)
                        n = 0
        yield from _sent(held[:n], block, min_count)

    def merge(batches):
        own, now = np.zeros(block, kind), None
        made = lambda: pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([finish(own)], pa.binary())], names=["block", "cells"])
        for batch in batches:
            for k, raw in zip(batch.column("block").to_pylist(), batch.column("cells")):
                if k != now:
                    if now is not None:
                        yield made()
                    own[:], now = 0, k
                at = places(raw.as_buffer())
                first = np.flatnonzero(np.diff(at, prepend=-1))
                own[at[first]] = np.minimum(own[at[first]] + np.diff(np.append(first, len(at))), min_count)
        if now is not None:
            yield made()

    shape = "block int, cells binary"
    got = _texts(docs).mapInArrow(count, shape).repartition("block").sortWithinPartitions("block").mapInArrow(merge, shape).toArrow()
    return zip(got.column("block").to_pylist(), (x.as_buffer() for x in got.column("cells")))


def sketch(docs: DataFrame, bits: int, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, depth: int = DEPTH) -> np.ndarray:
    """The merged sketch of docs(lang, text): (depth, 2**bits) counts, never too small, clipped at min_count."""
    kind, block = _cell_type(min_count), min(BLOCK, 1 << bits)
    out = np.zeros(((depth << bits) // block, block), kind)
    for k, raw in _merged(docs, bits, min_count, max_words, depth, lambda own: own.tobytes()):
        out[k] = np.frombuffer(raw, kind)
    return out.reshape(depth, -1)


def full_cells(docs: DataFrame, bits: int, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS) -> np.ndarray:
    """Of the sketch's cells which reach min_count, a bit each."""
    step = max(1, min(BLOCK, 1 << bits) // 8)
    out = np.zeros(max(1, (1 << bits) // 8), np.uint8)
    for k, raw in _merged(docs, bits, min_count, max_words, 1, lambda own: np.packbits(own >= min_count, bitorder="little").tobytes()):
        out[k * step : (k + 1) * step] = np.frombuffer(raw, np.uint8)
    return out


def survivors(grams: Grams, full: np.ndarray, bits: int, max_words: int = MAX_WORDS) -> np.ndarray:
    """The n-grams that may be frequent: their cells are full, and those of the two that are a word shorter."""
    at = columns(grams.hash, bits, 1)[0]
    passed = (full[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0
    out, shorter = [], None
    for k in range(1, max_words + 1):
        a, b = np.searchsorted(grams.size, [k, k + 1])
        own = a + np.flatnonzero(passed[a:b])
        if k > 1:
            own = own[shorter[grams.word[own]] & shorter[grams.word[own] + 1]]
        shorter = ~grams.begun  # those that begin in the next stretch aren't known here
        shorter[grams.word[own]] = True
        out.append(own)
    return np.concatenate(out)


def counts(docs: DataFrame, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, bits: int | None = None) -> DataFrame:
    """lang, phrase, words, f of every n-gram with f >= min_count, and a row of words = 0 with the number of all words for each language. Written."""
    spark = docs.sparkSession
    bits = width(docs, min_count) if bits is None else bits
    known = spark.sparkContext.broadcast(full_cells(docs, bits, min_count, max_words))

    def count(batches):
        for grams, langs in _grams(batches, max_words):
            live = survivors(grams, known.value, bits, max_words)
            live = live[np.argsort(grams.hash[live], kind="stable")]
            h, g = grams.hash[live], grams.check[live]
            fresh = np.ones(len(live), bool)
            fresh[1:] = (h[1:] != h[:-1]) | (g[1:] != g[:-1])
            first = np.flatnonzero(fresh)
            one, times = live[first], np.diff(np.append(first, len(live)))
            of = langs.take(pa.array(grams.row[grams.word[one]]))
            yield pa.RecordBatch.from_arrays([of, grams.strings(one), pa.array(grams.size[one].astype(np.int32)), pa.array(times.astype(np.int64))], names=["lang", "phrase", "words", "c"])
            begun = np.bincount(grams.row[grams.begun], minlength=len(langs))
            some = np.flatnonzero(begun)
            yield pa.RecordBatch.from_arrays([langs.take(pa.array(some)), pa.nulls(len(some), pa.string()), pa.array(np.zeros(len(some), np.int32)), pa.array(begun[some].astype(np.int64))], names=["lang", "phrase", "words", "c"])

    found = _texts(docs).mapInArrow(count, "lang string, phrase string, words int, c long")
    out = settle(found.groupBy("lang", "phrase", "words").agg(F.sum("c").alias("f")).where(f"words = 0 or f >= {min_count}"), "phrases")
    known.destroy()
    return out


def scored(counted: DataFrame, scale: int = SCALE) -> DataFrame:
    """lang, phrase, a, l, r, score of each candidate of counts(), at its lowest cut."""
    cuts = counted.where("words >= 2").select("lang", "phrase", F.col("f").alias("a"), "words", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.withColumns({"left": F.expr("substring_index(phrase, ' ', k)"), "right": F.expr("substring_index(phrase, ' ', k - words)")}).drop("words")
    part = lambda side, name: counted.where("words >= 1").select(F.col("lang").alias(f"{side}_lang"), F.col("phrase").alias(f"{side}_phrase"), F.col("f").alias(name))
    for side, name in (("left", "l"), ("right", "r")):
        cuts = cuts.join(part(side, name), F.expr(f"lang = {side}_lang and {side} = {side}_phrase")).drop(f"{side}_lang", f"{side}_phrase", side)
    score = F.expr(f"cast({scale} * cast(a as decimal(20, 0)) div (cast(l as decimal(20, 0)) + r) as long)")
    best = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    return best.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")


def subsumed(counted: DataFrame) -> DataFrame:
    """lang, phrase, longest: of the phrases inside longer candidates the highest count of such a candidate."""
    words = F.split("phrase", " ")
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.col("words") - m + 1), lambda i: F.array_join(F.slice(words, i, m), " "))))
    return counted.where("words >= 3").select("lang", F.explode(inner).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("longest"))


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, percent: int = PERCENT, top: int = TOP, scale: int = SCALE, bits: int | None = None) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the `top` phrases of each language of docs(lang, text)."""
    counted = counts(docs, min_count, max_words, bits)
    inside = subsumed(counted).withColumnsRenamed({"lang": "__lang", "phrase": "__phrase"})
    kept = scored(counted, scale).join(inside, F.expr("lang = __lang and phrase = __phrase"), "left")
    kept = kept.where(F.expr(f"longest is null or 100 * cast(longest as decimal(20, 0)) < {percent} * cast(a as decimal(20, 0))")).drop("__lang", "__phrase", "longest")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = kept.withColumn("__salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    first = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "__salt").orderBy(*order))).where(f"rank <= {top}").drop("__salt", "rank")
    best = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(f"rank <= {top}")
    totals = counted.where("words = 0").select(F.col("lang").alias("__lang"), F.col("f").alias("n"))
    return best.join(totals, F.col("lang") == F.col("__lang")).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def oracle_sql(min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, percent: int = PERCENT, top: int = TOP, scale: int = SCALE) -> str:
    """collocations() over the view `documents` in DuckDB's SQL."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    sizes = ", ".join(f"({k})" for k in range(1, max_words + 1))
    return rf"""
with piece as (select coalesce(lang, '{UNKNOWN}') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{upper}', '{lower}'), '[.,;:!?\x0A-\x0D]')) as p from documents),
w as (select lang, regexp_extract_all(p, '[^\x20\x09]+') as ws from piece),
total as (select lang, sum(len(ws))::bigint as n from w group by lang),
gram as (select lang, m as words, array_to_string(ws[i:i + m - 1], ' ') as phrase from (select lang, ws, m, unnest(range(1, len(ws) - m + 2)) as i from w, (values {sizes}) t(m) where len(ws) >= m)),
f as (select lang, words, phrase, count(*) as f, string_split(phrase, ' ') as ws from gram group by lang, words, phrase having count(*) >= {min_count}),
cut as (select c.lang, c.phrase, c.f as a, k, x.f as l, y.f as r, (({scale})::hugeint * c.f) // (x.f + y.f) as score
    from (select *, unnest(range(1, words)) as k from f where words >= 2) c join f x on x.lang = c.lang and x.phrase = array_to_string(c.ws[1:k], ' ') join f y on y.lang = c.lang and y.phrase = array_to_string(c.ws[k + 1:], ' ')),
low as (select * from cut qualify row_number() over (partition by lang, phrase order by score, k) = 1),
inner_part as (select lang, f, array_to_string(ws[i:i + m - 1], ' ') as phrase from (select *, unnest(range(1, words - m + 2)) as i from (select *, unnest(range(2, words)) as m from f where words >= 3))),
longest as (select lang, phrase, max(f) as most from inner_part group by lang, phrase),
kept as (select low.* from low left join longest using (lang, phrase) where most is null or 100::hugeint * most < {percent}::hugeint * a),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept)
select lang, rank::bigint as rank, phrase, a::bigint as a, l::bigint as l, r::bigint as r, n, score::bigint as score from ranked join total using (lang) where rank <= {top}"""
