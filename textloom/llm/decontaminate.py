"""Benchmark decontamination by canonical templates.

Words lose the punctuation around them and their case (of the whole of Unicode); words of punctuation alone are passed over. Numbers,
units after a number, and names (capitalised words that don't begin a sentence or a line) become typed
placeholders, so that a question with other numbers, names or units has the same template. Every window of WINDOW words of the
documents and of the benchmark gets a hash of its template and one of its words as they are, so that copies in other
case are found whatever their names are typed as. Windows meet by a join on the hash:

1. One pass over the documents keeps the windows whose hash the benchmark has: by the exact set of its hashes, or, of a benchmark with more
   than EXACT_HASHES, by a bitmap of at most 2**MAX_BITS bits, whose false hits the join drops.
2. Hits are joined with the benchmark's windows. Hashes with more than HOT postings (an instruction that many items share) are left out
   of this join. Of them each text keeps one window for each wording, and these go only to items that the text meets anyhow, or
   whose hot windows alone could make a leak, and there by the rarest of them: windows are probes unless all the more frequent ones together
   stay below both bounds of a leak. So a hot window costs its rows, not its pairs.
3. Hits on one diagonal of a text and an item align their slots: if equal values of the item meet different values
   of the document, or the other way round, the windows that break the majority's mapping are dropped, and the whole
   diagonal where there is no majority. Hot windows are checked each by itself.

A document leaks an item if its consistent windows cover at least `coverage` of the item's words, or if it holds RUN or more
words of it in a row, every window of them word by word, whatever stands around them. Items with fewer than WINDOW words are looked up as a
whole; items with fewer than LEAST words match a whole line of a document, word by word. Templates must have more
literal words than placeholders; windows with fewer are found word by word.

One row for each leaking row and item: an empty table on either side gives none, null texts have no words, null ids
are kept as null, repeated rows give repeated rows, equal texts are judged once. Extra columns are ignored by `leaks` and kept by `clean`, which
adds none of its own. A text of any length is one row of tokens in one Python step; its hits travel one by one.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, rows_of, settle, span_hashes, text_slices, words, _Tables
from .shingles import multipliers

WINDOW, LEAST = 8, 4
#: Window hashes of the benchmark that are sent to all workers as they are; beyond, a bitmap of at most 2**MAX_BITS bits is.
EXACT_HASHES, MAX_BITS = 400_000, 27
#: Postings beyond which a window hash is hot.
HOT = 8
#: Ids of leaking documents that are broadcast to drop them; with more, a shuffle join does it.
BROADCAST_IDS = 500_000
COVERAGE = 0.5
#: Words in a row of an item that are a leak however long the item is.
RUN = 20
#: Units of measure, as words after a number. Fixed values.
UNITS = "mm cm m km in ft yd mi mg g kg t lb lbs oz ml l gal s sec min h hr hrs ms hz khz mhz ghz kb mb gb tb w kw mw v a k c f percent degrees meter meters metre metres kilometer kilometers kilometre kilometres mile miles foot feet inch inches yard yards gram grams kilogram kilograms pound pounds ounce ounces liter liters litre litres second seconds minute minutes hour hours day days week weeks month months year years dollar dollars euro euros cent cents".split()

_U = np.uint64
_LITERAL, _NUMBER, _NAME, _UNIT = 0, 1, 2, 3
_ENDS = np.zeros(256, bool)
_ENDS[list(b".!?:")] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[list(b"0123456789")] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[[b for b in range(33, 127) if not chr(b).isalnum()]] = True
_CURRENCY = np.zeros(256, bool)
_CURRENCY[list(b"$+-")] = True


@dataclass
class Tokens:
    row: np.ndarray
    value: np.ndarray  # hash of the normal form
    kind: np.ndarray
    template: np.ndarray  # value, or the placeholder's hash
    line: np.ndarray  # whether it begins a line


_SLOT = mix(np.arange(4, dtype=np.uint64) + _U(1000))


def folded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts with their case folded, and their offsets. Folding keeps every word, and the ASCII signs around it."""
    low = _Tables.get().lower[data]
    wide = np.concatenate([[0], np.cumsum(data >= 128)])[offsets]
    if not wide[-1]:
        return low, offsets
    raw = [low[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:])]
    for i in np.flatnonzero(np.diff(wide)):
        raw[i] = raw[i].decode("utf-8", "surrogateescape").casefold().encode("utf-8", "surrogateescape")
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)


def tokens(data: np.ndarray, offsets: np.ndarray) -> Tokens:
    """The canonical words of texts laid end to end."""
    starts, ends, _ = words(data, offsets)
    low, low_offsets = folded(data, offsets)
    low_starts, low_ends = (starts, ends) if low_offsets is offsets else words(low, low_offsets)[:2]
    row = rows_of(starts, offsets)
    a, b = starts.copy(), ends.copy()
    todo = np.flatnonzero(_PUNCT[data[a]]) if len(a) else np.zeros(0, np.int64)
    while len(todo):
        a[todo] += 1
        todo = todo[a[todo] < b[todo]]
        todo = todo[_PUNCT[data[a[todo]]]]
    todo = np.flatnonzero(b > a)
    todo = todo[_PUNCT[data[b[todo] - 1]]]
    while len(todo):
        b[todo] -= 1
        todo = todo[_PUNCT[data[b[todo] - 1]]]
    # does a word begin a sentence, a line or a text
    begins = np.ones(len(starts), bool)
    begins[1:] = _ENDS[data[ends[:-1] - 1]] | (row[1:] != row[:-1])
    line = np.ones(len(starts), bool)
    line[1:] = row[1:] != row[:-1]
    lines = np.searchsorted(starts, np.flatnonzero(data == 10))
    line[lines[lines < len(starts)]] = True
    begins |= line

    solid = b > a
    low_a, low_b = (low_starts + (a - starts))[solid], (low_ends - (ends - b))[solid]
    number = np.cumsum(line)[solid]
    a, b, row, begins = a[solid], b[solid], row[solid], begins[solid]
    line = np.ones(len(a), bool)
    line[1:] = number[1:] != number[:-1]
    value = span_hashes(low, low_a, low_b)
    first = data[a]
    second = data[np.minimum(a + 1, b - 1)] if len(a) else first
    kind = np.zeros(len(a), np.int8)
    kind[_DIGIT[first]] = _NUMBER
    upper = (first >= 65) & (first <= 90) & (second >= 97) | (first == 0xC3) & (second >= 0x80) & (second <= 0x9E) & (b - a > 2)
    kind[upper & ~begins & (b - a > 1)] = _NAME
    after = np.zeros(len(a), bool)
    after[1:] = (kind[:-1] == _NUMBER) & (row[1:] == row[:-1])
    near = np.flatnonzero(after & (kind != _NUMBER))
    kind[near[np.isin(value[near], _unit_hashes())]] = _UNIT
    return Tokens(row, value, kind, np.where(kind == _LITERAL, value, _SLOT[kind]), line)


_units: list[np.ndarray] = []


def _unit_hashes() -> np.ndarray:
    if not _units:
        raw = " ".join(UNITS).encode()
        data = np.frombuffer(raw, np.uint8)
        _units.append(words(data, np.array([0, len(raw)]))[2])
    return _units[0]


def _hash(each: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    total = np.full(len(at), width, np.uint64)
    for j, f in enumerate(multipliers(width, 5)):
        total += each[at + j] * f
    return mix(total)


def windows(t: Tokens, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The places where windows of `width` words in one text begin, their hashes, and whether they are word by word.

    First those that have more literals than slots, as templates; then all windows with slots, word by word. Below
    LEAST words: whole lines, word by word.
    """
    n = len(t.row) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, bool)
    whole = t.row[:n] == t.row[width - 1 :]
    if width < LEAST:
        ends = np.append(t.line, True)
        inner = np.concatenate([[0], np.cumsum(t.line)])
        at = np.flatnonzero(whole & t.line[:n] & ends[width : width + n] & (inner[width : width + n] - inner[:n] == 1))
        return at, mix(_hash(t.value, at, width) + _U(1)), np.ones(len(at), bool)
    slots = np.concatenate([[0], np.cumsum(t.kind != _LITERAL)])
    slots = slots[width:] - slots[:n]
    own, plain = np.flatnonzero(whole & (2 * slots < width)), np.flatnonzero(whole & (slots > 0))
    return np.concatenate([own, plain]), np.concatenate([_hash(t.template, own, width), _hash(t.value, plain, width)]), np.repeat([False, True], [len(own), len(plain)])


def _matrix(each: np.ndarray, at: np.ndarray, width: int) -> pa.Array:
    """A binary column with the items of each window."""
    raw = np.ascontiguousarray(each[at[:, None] + np.arange(width)]) if len(at) else np.zeros((0, width), each.dtype)
    step = width * each.dtype.itemsize
    offsets = np.arange(len(at) + 1, dtype=np.int32) * step
    return pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(raw.tobytes())])


_ITEM_WINDOWS = "item binary, n int, place int, width int, hash long, plain boolean, values binary, kinds binary"


def item_windows(items: DataFrame) -> DataFrame:
    """The windows of items(item binary, text); items without words have none."""

    def run(batches):
        for batch in batches:
            for part, data, offsets in text_slices(batch, "text"):
                t = tokens(data, offsets)
                sizes = np.bincount(t.row, minlength=len(offsets) - 1)
                first = np.cumsum(sizes) - sizes
                for width in sorted({WINDOW, *(int(n) for n in sizes if 0 < n < WINDOW)}):
                    at, hashes, plain = windows(t, width)
                    keep = sizes[t.row[at]] >= WINDOW if width == WINDOW else sizes[t.row[at]] == width
                    if width < LEAST:  # an item of several lines is one line here
                        at = first[sizes == width]
                        hashes, plain, keep = mix(_hash(t.value, at, width) + _U(1)), np.ones(len(at), bool), np.ones(len(at), bool)
                    at, hashes, plain = at[keep], hashes[keep], plain[keep]
                    row = t.row[at]
                    yield pa.RecordBatch.from_arrays(
                        [part.column("item").take(pa.array(row)), pa.array(sizes[row].astype(np.int32)), pa.array((at - first[row]).astype(np.int32)), pa.array(np.full(len(at), width, np.int32)),
                         pa.array(hashes.view(np.int64)), pa.array(plain), _matrix(t.value, at, width), _matrix(t.kind, at, width)],
                        names=[x.split()[0] for x in _ITEM_WINDOWS.split(", ")],
                    )

    return items.mapInArrow(run, _ITEM_WINDOWS)


class Members:
    """The window hashes of a benchmark: sorted with their hotness, or a bitmap."""

    def __init__(self, hashes: np.ndarray | None, hot: np.ndarray | None, bits: np.ndarray, shift: int, widths: list[int]):
        self.hashes, self.hot, self.bits, self.shift, self.widths = hashes, hot, bits, shift, widths

    @classmethod
    def of(cls, counted: DataFrame, widths: list[int], exact: int = EXACT_HASHES) -> Members:
        """counted: hash, c. What reaches the driver is bounded by EXACT_HASHES or by MAX_BITS."""
        n = counted.count()
        if n <= exact:
            rows = counted.orderBy(F.expr("hash ^ shiftleft(1L, 63)")).toArrow()  # as unsigned numbers
            hashes = rows.column("hash").to_numpy().view(np.uint64)
            bits = np.zeros(1 << 19, np.uint8)
            slots = (hashes >> _U(42)).astype(np.int64)
            np.bitwise_or.at(bits, slots >> 3, np.uint8(1) << (slots & 7).astype(np.uint8))
            return cls(hashes, rows.column("c").to_numpy() > HOT, bits, 42, widths)
        wide = min(MAX_BITS, max(10, int(np.ceil(np.log2(16 * n)))))
        slot = F.shiftrightunsigned("hash", 64 - wide)
        words_ = counted.groupBy(F.shiftright(slot, 6).alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, int(shiftrightunsigned(hash, {64 - wide}) & 63))")).alias("b")).toArrow()
        bits = np.zeros(1 << wide - 6, np.int64)
        bits[words_.column("w").to_numpy()] = words_.column("b").to_numpy()
        return cls(None, None, bits.view(np.uint8), 64 - wide, widths)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which hashes are members, or may be, and which of these are known to be hot."""
        slots = (hashes >> _U(self.shift)).astype(np.int64)
        maybe = np.flatnonzero(self.bits[slots >> 3] >> (slots & 7).astype(np.uint8) & 1)
        if self.hashes is None:
            return maybe, np.zeros(len(maybe), bool)
        if not len(self.hashes):
            return maybe[:0], np.zeros(0, bool)
        at = np.minimum(np.searchsorted(self.hashes, hashes[maybe]), len(self.hashes) - 1)
        there = self.hashes[at] == hashes[maybe]
        return maybe[there], self.hot[at[there]]


_HITS = "doc_id long, text_key binary, lead boolean, pos int, width int, hash long, plain boolean, theirs binary"


def hits(docs: DataFrame, members: Members) -> DataFrame:
    """The windows of docs(doc_id, text) that the benchmark has; of a hot one the first of each wording. lead marks one row for each document."""
    shared = docs.sparkSession.sparkContext.broadcast(members)

    def run(batches):
        own = shared.value
        for batch in batches:
            for part, data, offsets in text_slices(batch, "text"):
                t = tokens(data, offsets)
                sizes = np.bincount(t.row, minlength=len(offsets) - 1)
                first = np.cumsum(sizes) - sizes
                keys: dict[int, bytes] = {}
                for width in own.widths:
                    at, hashes, plain = windows(t, width)
                    which, hot = own.find(hashes)
                    if not len(which):
                        continue
                    if hot.any():
                        far = which[hot]
                        wording = np.rec.fromarrays([t.row[at[far]], hashes[far], _hash(t.value, at[far], width)])
                        which = np.sort(np.concatenate([which[~hot], far[np.unique(wording, return_index=True)[1]]]))
                    at, hashes, plain = at[which], hashes[which], plain[which]
                    row = t.row[at]
                    lead = np.zeros(len(at), bool)
                    for i, r in zip(*(x.tolist() for x in np.unique(row, return_index=True)[::-1])):
                        lead[i] = r not in keys
                        keys.setdefault(r, hashlib.md5(data[offsets[r] : offsets[r + 1]].tobytes()).digest())
                    step = 40_000
                    for k in range(0, len(at), step):
                        x = slice(k, k + step)
                        yield pa.RecordBatch.from_arrays(
                            [part.column("doc_id").take(pa.array(row[x])), pa.array([keys[r] for r in row[x].tolist()], pa.binary()), pa.array(lead[x]), pa.array((at - first[row])[x].astype(np.int32)),
                             pa.array(np.full(len(at[x]), width, np.int32)), pa.array(hashes[x].view(np.int64)), pa.array(plain[x]), _matrix(t.value, at[x], width)],
                            names=[x.split()[0] for x in _HITS.split(", ")],
                        )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _HITS)


def probes(hot: DataFrame, coverage: float) -> DataFrame:
    """item, hash: the hot windows (item, n, place, width, hash, c) one of which every leak of the item has that has hot windows alone."""

    def pick(group: pa.Table) -> pa.Table:
        n = group.column("n")[0].as_py()
        rows = sorted(zip(*(group.column(c).to_pylist() for c in ("c", "hash", "place", "width"))), reverse=True)
        mask, out = np.zeros(n, bool), []
        for _, h, place, width in rows:
            more = mask.copy()
            more[place : place + width] = True
            if more.sum() >= coverage * n or _runs(np.flatnonzero(more), n).max() >= RUN:
                out.append(h)
            else:
                mask = more
        return pa.table({"item": pa.array([group.column("item")[0].as_py()] * len(set(out)), pa.binary()), "hash": pa.array(sorted(set(out)), pa.int64())})

    return hot.groupBy("item").applyInArrow(pick, "item binary, hash long")


class Judge:
    """Decides on the hits of one text and one item."""

    def __init__(self, size: int, coverage: float):
        self.size, self.coverage = size, coverage
        self.covered, self.changed, self.begin = np.zeros(size, bool), np.zeros(size, bool), None

    def _take(self, mask: np.ndarray, differ: np.ndarray, diagonal: int) -> None:
        if mask.any():
            self.covered |= mask
            self.changed |= differ & mask
            at = int(np.argmax(mask)) + diagonal
            self.begin = at if self.begin is None else min(self.begin, at)

    def _agreeing(self, places: np.ndarray, widths: np.ndarray, ours: np.ndarray, theirs: np.ndarray, slot: np.ndarray) -> np.ndarray:
        """The words in windows whose slots map one to one."""
        mask = _cover(self.size, places, widths)
        slots = np.flatnonzero(mask & slot)
        bad = _minority(ours[slots], theirs[slots])
        if bad is None:  # one value stands for two
            return np.zeros(self.size, bool)
        if bad.any():
            before = np.cumsum(np.bincount(slots[bad] + 1, minlength=self.size + 1))
            good = before[places + widths] == before[places]
            mask = _cover(self.size, places[good], widths[good])
        return mask

    def diagonal(self, shift: int, places, widths, plain, ours, theirs, kinds) -> None:
        a, b, k = np.zeros(self.size, np.uint64), np.zeros(self.size, np.uint64), np.zeros(self.size, np.int8)
        for p, w, x, y, z in zip(places.tolist(), widths.tolist(), ours, theirs, kinds):
            a[p : p + w], b[p : p + w], k[p : p + w] = x[:w], y[:w], z[:w]
        slot = k != _LITERAL
        mask = self._agreeing(places, widths, a, b, slot)
        if not plain.all():  # what templates say by themselves isn't lost to windows that are equal word by word
            mask |= self._agreeing(places[~plain], widths[~plain], a, b, slot)
        self._take(mask, slot & (a != b), shift)

    def runs(self, places: np.ndarray, positions: np.ndarray) -> int:
        """Takes the runs of RUN words and more from the places of WINDOW words that are equal word by word; the longest run."""
        if not len(places):
            return 0
        shifts = positions.astype(np.int64) - places  # in a row in the item and in the text as well: along one diagonal
        order = np.lexsort((places, shifts))
        places, shifts = places[order], shifts[order]
        same = shifts[1:] == shifts[:-1]
        first = np.concatenate([[True], (places[1:] != places[:-1]) | ~same])
        places, shifts = places[first], shifts[first]
        cuts = np.flatnonzero(np.concatenate([[True], (np.diff(places) > 1) | (shifts[1:] != shifts[:-1]), [True]]))
        longest = 0
        for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            n = y - x + WINDOW - 1
            longest = max(longest, n)
            if n >= RUN:
                mask = np.zeros(self.size, bool)
                mask[places[x] : places[x] + n] = True
                self._take(mask, np.zeros(self.size, bool), int(shifts[x]))
        return longest

    def verdict(self, pos, place, width, plain, alone, ours, theirs, kinds) -> tuple | None:
        """(words, covered words, first word, changed slots) of a leak, or None."""
        inside = np.arange(WINDOW) < width[:, None]
        equal = ((ours == theirs) | ~inside).all(axis=1)
        shift = pos - place
        seen = set()
        order = np.lexsort((place, np.where(alone, np.arange(len(pos)), shift), alone))
        key = np.where(alone[order], -1 - np.arange(len(pos)), shift[order].astype(np.int64) + (1 << 40))
        cuts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
        for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            g = order[x:y]
            content = (place[g].tobytes(), plain[g].tobytes(), theirs[g].tobytes())
            if content in seen:  # the same words again at another place
                continue
            seen.add(content)
            self.diagonal(int(shift[g[0]]), place[g], width[g], plain[g], ours[g], theirs[g], kinds[g])
        whole = equal & (width == WINDOW)
        run = self.runs(place[whole], pos[whole])
        n = int(self.covered.sum())
        if self.begin is None or not (n >= self.coverage * self.size or run >= RUN):
            return None
        return self.size, n, self.begin, int(self.changed.sum())


def _cover(size: int, places: np.ndarray, widths: np.ndarray) -> np.ndarray:
    """The words of an item that windows hold."""
    mask = np.zeros(size, bool)
    for p, w in zip(places.tolist(), widths.tolist()):
        mask[p : p + w] = True
    return mask


def _runs(places: np.ndarray, size: int) -> np.ndarray:
    """For each word of an item how many of `places` stand in a row around it."""
    out = np.zeros(size, np.int64)
    if len(places):
        cuts = np.flatnonzero(np.concatenate([[True], np.diff(places) > 1, [True]]))
        out[places] = np.repeat(np.diff(cuts), np.diff(cuts))
    return out


def _minority(left: np.ndarray, right: np.ndarray) -> np.ndarray | None:
    """The slots that break the mapping of most of their value's occurrences on both sides; None if a value has no such mapping."""
    pairs = Counter(zip(left.tolist(), right.tolist()))
    mine, theirs = Counter(left.tolist()), Counter(right.tolist())
    good = {(a, b) for (a, b), n in pairs.items() if 2 * n > mine[a] and 2 * n > theirs[b]}
    known, met = {a for a, _ in good}, {b for _, b in good}
    if any(p not in good and p[0] not in known and p[1] not in met for p in pairs):
        return None
    return np.array([p not in good for p in zip(left.tolist(), right.tolist())], bool)


_JUDGED = "text_key binary, item binary, item_words long, covered_words long, first_word long, changed_slots long"


def _padded(column: pa.Array, dtype) -> np.ndarray:
    """A matrix of WINDOW columns from a binary column."""
    out = np.zeros((len(column), WINDOW), dtype)
    for i, raw in enumerate(column.to_pylist()):
        own = np.frombuffer(raw, dtype)
        out[i, : len(own)] = own
    return out


def _groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """Tables of whole groups of rows that come sorted by keys."""
    rest: list[pa.RecordBatch] = []
    at = None
    for batch in batches:
        rows = list(zip(*(batch.column(k).to_pylist() for k in keys)))
        start = 0
        for i, r in enumerate(rows):
            if r != at:
                if i > start:
                    rest.append(batch.slice(start, i - start))
                if rest:
                    yield pa.Table.from_batches(rest)
                rest, at, start = [], r, i
        if start < len(rows):
            rest.append(batch.slice(start))
    if rest:
        yield pa.Table.from_batches(rest)


def _by_text(docs: DataFrame, benchmark: DataFrame, coverage: float, exact_hashes: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(leaks by text_key and item, text_key and doc_id of the documents with hits, item and item_id of the benchmark)."""
    ids = settle(benchmark.select(F.unhex(F.md5("text")).alias("item"), F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null"), "items")
    posted = settle(item_windows(ids.select("item", "text").dropDuplicates(["item"])), "item-windows")
    counted = settle(posted.groupBy("hash").agg(F.count(F.lit(1)).alias("c")), "item-hashes")
    widths = sorted(r[0] for r in posted.select("width").distinct().collect())  # WINDOW at most
    found = settle(hits(docs, Members.of(counted, widths, exact_hashes)), "hits")
    owners = found.where("lead").select("text_key", "doc_id")
    met = found.drop("doc_id", "lead").dropDuplicates(["text_key", "pos", "width", "hash", "plain"])
    hot = F.col("c") > HOT
    posted = posted.withColumnsRenamed({"plain": "__plain", "values": "ours"}).join(counted, "hash")
    columns = ["text_key", "item", "n", "pos", "place", "width", (F.col("plain") | F.col("__plain")).alias("plain"), hot.alias("alone"), "ours", "theirs", "kinds"]
    rows = met.join(posted.where(~hot), ["hash", "width"]).select(*columns)
    crowded = settle(posted.where(hot), "hot-windows")
    if not crowded.isEmpty():
        rows = settle(rows, "cold-hits")
        few = settle(met.join(crowded.select("hash").distinct(), "hash", "left_semi").groupBy("text_key", "width", "hash", "plain", "theirs").agg(F.min("pos").alias("pos")), "hot-hits")
        by_probe = few.select("text_key", "hash").join(probes(crowded, coverage), "hash").select("text_key", "item")
        pairs = settle(rows.select("text_key", "item").unionByName(by_probe).distinct(), "pairs")
        rows = rows.unionByName(pairs.join(few, "text_key").join(crowded, ["item", "hash", "width"]).select(*columns))

    def run(batches):
        for group in _groups(batches, ("text_key", "item")):
            number = lambda c: group.column(c).to_numpy().astype(np.int64)
            flag = lambda c: np.array(group.column(c).to_pylist(), bool)
            judge = Judge(group.column("n")[0].as_py(), coverage)
            kinds = _padded(group.column("kinds"), np.int8)
            got = judge.verdict(number("pos"), number("place"), number("width"), flag("plain"), flag("alone"), _padded(group.column("ours"), np.uint64), _padded(group.column("theirs"), np.uint64), kinds)
            if got:
                keys = [pa.array([group.column(c)[0].as_py()], pa.binary()) for c in ("text_key", "item")]
                yield pa.RecordBatch.from_arrays(keys + [pa.array([x], pa.int64()) for x in got], names=[x.split()[0] for x in _JUDGED.split(", ")])

    dealt = rows.repartition("text_key", "item").sortWithinPartitions("text_key", "item", "place", "pos")
    return settle(dealt.mapInArrow(run, _JUDGED), "leaks"), owners, ids


def leaks(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, exact_hashes: int = EXACT_HASHES) -> DataFrame:
    """A row for each row of docs(doc_id, text) that leaks an item of benchmark(item_id, text)."""
    found, owners, ids = _by_text(docs, benchmark, coverage, exact_hashes)
    return owners.join(found, "text_key").join(ids.select("item", "item_id"), "item").select("doc_id", "item_id", "item_words", "covered_words", "first_word", "changed_slots")


def clean(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, exact_hashes: int = EXACT_HASHES) -> DataFrame:
    """The rows of docs that leak no item, with their columns. Rows of one doc_id share its verdict; rows with a null one are judged by their text alone."""
    found, owners, _ = _by_text(docs, benchmark, coverage, exact_hashes)
    bad = settle(owners.join(found.select("text_key").distinct(), "text_key", "left_semi").distinct(), "leaking")
    few = bad.count() <= BROADCAST_IDS
    side = lambda df: F.broadcast(df) if few else df
    ids = bad.where("doc_id is not null").select(F.col("doc_id").alias("__bad")).distinct()
    kept = docs.where("doc_id is not null").join(side(ids), F.col("doc_id").cast("long") == F.col("__bad"), "left_anti")
    texts = bad.where("doc_id is null").select(F.col("text_key").alias("__bad"))
    spared = docs.where("doc_id is null").join(side(texts), F.unhex(F.md5("text")) == F.col("__bad"), "left_anti")
    return kept.unionByName(spared).select(*[f"`{c}`" for c in docs.columns])
