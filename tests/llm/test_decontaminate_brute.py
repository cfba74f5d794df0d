"""Decontamination against a plain version on strings, with numbers, units, names and slots; hot windows; odd rows."""

import random
import re
import time
from collections import Counter

import pytest

from textloom.llm import decontaminate as d

EDGE = "".join(chr(b) for b in range(33, 127) if not chr(b).isalnum())


def words(text):
    """(word, kind) as the docstring has it."""
    out, begins = [], True
    for line in text.split("\n"):
        begins = True
        for raw in line.split():
            w = raw.strip(EDGE)
            if w:
                kind = "number" if w[0].isdigit() else "name" if not begins and len(w) > 1 and w[0].isupper() and w[1].islower() else "word"
                if kind != "number" and out and out[-1][1] == "number" and w.casefold() in d.UNITS:
                    kind = "unit"
                out.append((w.casefold(), kind))
            begins = raw[-1] in ".!?:"
    return out


def consistent(size, starts, a, b, slot, width):
    """The places of an item in windows whose slots map one to one by majority."""
    cover = {p + j for p in starts for j in range(width)}
    slots = sorted(p for p in cover if slot(p))
    pairs = Counter((a[p][0], b[p][0]) for p in slots)
    mine, theirs = Counter(a[p][0] for p in slots), Counter(b[p][0] for p in slots)
    good = {q for q, n in pairs.items() if 2 * n > mine[q[0]] and 2 * n > theirs[q[1]]}
    if any(q not in good and q[0] not in {x for x, _ in good} and q[1] not in {y for _, y in good} for q in pairs):
        return set()
    bad = {p for p in slots if (a[p][0], b[p][0]) not in good}
    return {s + j for s in starts if not bad & set(range(s, s + width)) for j in range(width)}


def leaks(text, item, coverage=0.5):
    t, own = words(text), words(item)
    n = len(own)
    width = min(d.WINDOW, n)
    mask = lambda w: [x if k == "word" else "<" + k for x, k in w]
    covered, verbatim = set(), set()
    for shift in range(-n, len(t) + 1):
        templates, plain = [], []
        for p in range(n - width + 1):
            q = p + shift
            if q < 0 or q + width > len(t):
                continue
            x, y = own[p : p + width], t[q : q + width]
            few = lambda w: 2 * sum(k != "word" for _, k in w) < width
            if [v for v, _ in x] == [v for v, _ in y]:
                verbatim.add(p)
                plain.append(p)
            if few(x) and few(y) and mask(x) == mask(y):
                templates.append(p)
        b = {p: t[p + shift] for p in range(n) if 0 <= p + shift < len(t)}
        slot = lambda p: own[p][1] != "word"
        if templates or plain:
            covered |= consistent(n, sorted(set(templates) | set(plain)), own, b, slot, width)
            covered |= consistent(n, templates, own, b, slot, width)
    runs, run, last = 0, 0, -9
    for p in sorted(verbatim):
        run = run + 1 if p == last + 1 else width
        runs, last = max(runs, run), p
        if run >= d.RUN:
            covered |= set(range(p + width - run, p + width))
    return len(covered) if n and (len(covered) >= coverage * n or runs >= d.RUN) else None


def found(spark, texts, items, **options):
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    return {(r.doc_id, r.item_id): r for r in d.leaks(docs, spark.createDataFrame(items, "item_id long, text string"), **options).collect()}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_slots_against_brute_force(spark, seed):
    r = random.Random(seed)
    names, units = "Alice Bob Carol Dieter Émile Berlin Boston Ümit".split(), "km hours kg miles dollars".split()

    def word():
        k = r.random()
        return str(r.choice([3, 7, 12, 40, 41])) if k < 0.16 else r.choice(names) if k < 0.28 else r.choice(units) if k < 0.4 else r.choice("the of red green apples boxes to market by old truck runs every day (and) with, all.".split())

    def changed(w):
        k = r.random()
        if k < 0.25:
            return w
        if k < 0.5:  # one to one
            map_ = {"3": "8", "7": "9", "12": "75", "Alice": "Nina", "Berlin": "Paris", "km": "miles"}
            return [map_.get(x, x) for x in w]
        if k < 0.75:
            at = r.randrange(len(w))
            return [*w[:at], str(r.choice([3, 40, 99])), *w[at + 1 :]]
        return [x.upper() for x in w] if k < 0.85 else w[: len(w) * 2 // 3]

    items = [(i, " ".join(word() for _ in range(r.randrange(4, 34)))) for i in range(14)]
    texts = []
    for i in range(70):
        w = [word() for _ in range(r.randrange(3, 30))]
        for _ in range(r.randrange(3)):
            at = r.randrange(len(w))
            w[at:at] = changed(r.choice(items)[1].split())
        texts.append((i, " ".join(w)))
    want = {(i, k): n for i, t in texts for k, item in items if (n := leaks(t, item)) is not None}
    got = {k: v.covered_words for k, v in found(spark, texts, items).items()}
    assert got == want and len(want) > 20
    assert set(found(spark, texts, items, exact_hashes=0)) == set(want)


def test_exact_copies_of_any_item(spark):
    items = [(1, "What is 3 + 4 * 5 - 6 / 2 when 7 = 9 ?"), (2, "Yes"), (3, "is 42 right"), (4, "12 13 14 15"), (5, " "), (6, "Add Alice Bob Carol Dieter"), (7, "one\ntwo three")]
    texts = [(i, f"some words before.\n{t}\nand after") for i, t in items] + [(20, "yes and no"), (21, "is 42 right or wrong"), (22, "so\nyes.\nno"), (23, "one two three")]
    assert set(found(spark, texts, items)) == {(1, 1), (2, 2), (3, 3), (4, 4), (6, 6), (22, 2), (23, 7)}


def test_hot_windows_cost_their_rows(spark):
    r = random.Random(5)
    make = lambda n: " ".join("".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(n))
    shared = make(12)
    items = [(i, f"{shared} {make(20)}") for i in range(1500)] + [(i, f"{shared} {make(6)}") for i in range(1500, 1530)]
    long = make(30)
    items += [(i, f"{long} {make(60)}") for i in range(2000, 2020)]  # a run of more than RUN words is a leak of each
    texts = [(1, " . ".join([shared] * 4000)), (2, items[7][1]), (3, " so ".join(t for _, t in items[:300])), (4, shared), (5, long), (6, shared[: len(shared) // 2])]
    start = time.process_time()
    got = set(found(spark, texts, items))
    small = {(d_, i) for d_ in (1, 2, 3, 4) for i in range(1500, 1530)}
    assert got == small | {(2, 7)} | {(3, i) for i in range(300)} | {(5, i) for i in range(2000, 2020)}
    assert time.process_time() - start < 20


def test_odd_rows(spark):
    item = "Each of 40 boxes holds some red apples and green pears from Berlin."
    docs = spark.createDataFrame([(1, item, "x"), (1, item, "x"), (None, item, "y"), (2, None, "z"), (3, "", "z"), (4, "fine " * 60_000 + item + " fine" * 60_000, "w")], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([(1, item, 5), (1, item, 5), (None, None, 6)], "item_id long, text string, doc_id int")
    got = sorted((r.doc_id or 0, r.item_id, r.covered_words) for r in d.leaks(docs, bench).collect())
    assert got == sorted([(1, 1, 13), (1, 1, 13), (0, 1, 13), (4, 1, 13)] * 2)
    kept = d.clean(docs, bench)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3]
    assert d.leaks(docs.limit(0), bench).count() == 0 and d.leaks(docs, bench.limit(0)).count() == 0 and d.clean(docs, bench.limit(0)).count() == 6
