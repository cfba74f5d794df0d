import random
import re
import tracemalloc
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.llm import phrases as p

NAMES = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def plain(rows, min_count, percent=80, top=2000, scale=2_000_000, most=4):
    """The same in plain Python: (lang, rank, phrase, a, l, r, n, score)."""
    count, total = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            w = re.findall("[^ \t]+", piece)
            total[lang] += len(w)
            for k in range(1, most + 1):
                for i in range(len(w) - k + 1):
                    count.setdefault(lang, Counter())[tuple(w[i : i + k])] += 1
    out = []
    for lang, f in count.items():
        own = {g: a for g, a in f.items() if len(g) > 1 and a >= min_count}
        kept = []
        for g, a in own.items():
            if any(100 * b >= percent * a and any(x[i : i + len(g)] == g for i in range(len(x) - len(g) + 1)) for x, b in own.items() if len(x) > len(g)):
                continue
            score, k = min((scale * a // (f[g[:k]] + f[g[k:]]), k) for k in range(1, len(g)))
            kept.append((-score, -a, " ".join(g).encode(), f[g[:k]], f[g[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, total[lang], -score))
    return sorted(out)


def corpus(seed, n=150):
    r = random.Random(seed)
    vocab = ["Ab", "ab", "c", "dé", "É", "x#", "new", "york", "city"]
    weights = [1 + 2 * (i % 3) for i in range(len(vocab))]
    text = lambda: "".join(r.choices(vocab, weights)[0] + r.choice([" ", " ", "  ", "\t", " ", ". ", ",", "\n", " "]) for _ in range(r.randrange(60)))
    return [(r.choice(["en", "en", "de", None]), text() + (" new york city" * r.randrange(3))) for _ in range(n)]


def collected(df):
    return sorted(tuple(r) for r in df.select(*NAMES).collect())


@pytest.mark.parametrize("seed,min_count,percent,top", [(1, 5, 80, 2000), (2, 3, 60, 7), (3, 30, 80, 2000)])
def test_against_plain(spark, seed, min_count, percent, top):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "lang string, text string")
    got = collected(p.collocations(df, min_count=min_count, percent=percent, top=top, bits=18))
    assert got == plain(rows, min_count, percent, top) and len(got) > 10


def test_narrow_sketch_and_sql(spark):
    """A sketch in which all n-grams collide changes nothing; the SQL says the same."""
    rows = corpus(4)
    df = spark.createDataFrame(rows, "lang string, text string").repartition(5)
    got = collected(p.collocations(df, min_count=6, bits=3))
    con = duckdb.connect()
    con.register("documents", df.toArrow())
    cursor = con.execute(p.oracle_sql(min_count=6))
    names = [c[0] for c in cursor.description]
    want = sorted(tuple(dict(zip(names, r))[c] for c in NAMES) for r in cursor.fetchall())
    assert got == want == plain(rows, 6)


def test_sketch_never_underestimates(spark):
    df = spark.createDataFrame(corpus(5), "lang string, text string").repartition(3)
    bits, least = 6, 300
    cells = p.sketch(df, bits, min_count=least)
    assert cells.dtype == np.uint16
    true = Counter()
    for grams, _ in p._grams(p._texts(df).toArrow().to_batches(), 4):
        true.update(grams.hash.tolist())
    keys = np.array(list(true), np.uint64)
    low = np.min([row[at] for row, at in zip(cells, p.columns(keys, bits))], axis=0)
    assert all(e >= min(least, true[k]) for k, e in zip(keys.tolist(), low.tolist()))


def test_stretches_of_long_texts():
    r = random.Random(6)
    for _ in range(300):
        raw = "".join(r.choice("ab  \t.\n") for _ in range(r.randrange(1, 90))).encode()
        data, bounds = np.frombuffer(raw, np.uint8), np.array([0, len(raw)], np.int64)
        seeds = np.array([9], np.uint64)
        whole = p.Grams(data, bounds, len(raw), seeds, 4)
        parts = [p.Grams(d, b, limit, seeds, 4) for d, b, limit in p.stretches(data, bounds, 4, 8)]
        assert Counter(whole.strings(np.arange(len(whole.hash))).to_pylist()) == Counter(x for g in parts for x in g.strings(np.arange(len(g.hash))).to_pylist())
        assert sum(int(g.begun.sum()) for g in parts) == len(raw.decode().replace(".", " ").split())


def test_odd_rows(spark):
    long = "aa bb " * 200_000
    rows = [(1, "en", long, 1), (1, "en", long, 1), (None, None, None, 2), (2, "en", "", 3), (3, None, "one two " * 40, None), (4, "x", " .\t.\n", 4)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string, score int").withColumn("rank", F.lit("z"))
    got = collected(p.collocations(df))
    assert {r[2]: r[3] for r in got if r[0] == "en"} == {"aa bb aa bb": 399_998, "bb aa bb aa": 399_996}
    assert {(r[0], r[6]) for r in got} == {("en", 800_000), ("und", 80)}
    none = p.collocations(df.limit(0))
    assert none.count() == 0 and tuple(none.columns) == NAMES


def test_places_as_gaps():
    r = np.random.default_rng(7)
    for top in (3, 300, 10**6, 2**32 - 1):
        at = np.sort(r.integers(0, top, 500, dtype=np.uint64).astype(np.uint32))
        assert p.places(p.gaps(at)).tolist() == at.tolist()
    assert not len(p.places(p.gaps(at[:0])))


def test_sketch_grows_with_the_text(spark):
    """Of rare n-grams few reach the second pass, whatever the size; all frequent ones do."""
    r = np.random.default_rng(8)
    for n in (400, 3200):
        rows = [("en", " ".join(f"{x:x}" for x in r.integers(0, 1 << 40, 60)) + " ab cd") for _ in range(n)]
        docs = p._texts(spark.createDataFrame(rows, "lang string, text string"))
        bits = p.width(docs)
        assert 12 * 2**bits <= sum(len(t) for _, t in rows) <= 24 * 2**bits or bits == p.MIN_BITS
        full, live, of = p.full_cells(docs, 13 if n == 400 else 16), Counter(), 0
        for grams, _ in p._grams(docs.toArrow().to_batches(), 4):
            own = p.survivors(grams, full, 13 if n == 400 else 16)
            live.update(grams.strings(own).to_pylist())
            of += len(grams.hash)
        assert live["ab"] == live["ab cd"] == n and sum(live.values()) - 3 * n < 0.05 * of


@pytest.mark.parametrize("bits", [20, 22, 32])
def test_cells_are_sent_without_copies_of_all(bits):
    """A task's cells are sorted in place and sent in small batches; the receiver has each cell's count, clipped."""
    cells = np.random.default_rng(9).integers(0, 1 << bits, 1 << 22, dtype=np.uint64).astype(np.uint32)
    cells[:100_000] = cells[-1]
    known, times = np.unique(cells, return_counts=True)
    list(p._sent(cells[:9].copy(), p.BLOCK, 30))  # what is imported on first use isn't counted
    got = []
    tracemalloc.start()
    for batch in p._sent(cells, p.BLOCK, 30):
        now = tracemalloc.get_traced_memory()
        assert now[1] - sum(at.nbytes for at in got) < cells.nbytes and batch.nbytes < p.SENT + 2 * p.PIECE
        got += [p.places(raw.as_buffer()) + k * p.BLOCK for k, raw in zip(batch.column("block").to_pylist(), batch.column("cells"))]
        tracemalloc.reset_peak()
    tracemalloc.stop()
    sent, n = np.unique(np.concatenate(got), return_counts=True)
    assert (sent == known).all() and (np.minimum(n, 30) == np.minimum(times, 30)).all()
