import random
import zlib

import numpy as np
import pytest

from textloom.llm import quality as q


def pack(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)


def corpus(seed, n):
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdefghij") for _ in range(r.randrange(2, 8))) for _ in range(400)]
    out = []
    for _ in range(n):
        w = [r.choice(vocab) for _ in range(r.randrange(5, 120))]
        good = int(r.random() < 0.8)
        out.append((" ".join(w).capitalize() + "." if good else r.choice(["!! ", " | ", "%%% "]).join(x.upper() if r.random() < 0.5 else x for x in w), good))
    return out


def test_linear_time_identity():
    rng = np.random.default_rng(0)
    m = q.Machine(0.3, rng.standard_normal(q._SIZE).astype(np.float32), rng.standard_normal((q._SIZE, q.RANK)).astype(np.float32), np.zeros(q._N), np.ones(q._N), np.zeros((q._N, q.BINS - 1)))
    data, offsets = pack(["one two two three", "", "A b!"])
    row, at, x = q._vector(m, q.features(data, offsets), None)
    got, _, _ = q._margin(m, row, at, x)
    for i in range(3):
        own = np.flatnonzero(row == i)
        want = 0.3 + sum(float(m.w[at[k]] * x[k]) for k in own)
        want += sum(float(m.v[at[a]] @ m.v[at[b]]) * float(x[a] * x[b]) for a in own for b in own if a < b)
        assert got[i] == pytest.approx(want, rel=1e-3)


def test_statistics():
    data, offsets = pack(["AB cd. cd.\nx\nx\nx!", "", "é|"])
    s = {n: q.features(data, offsets).stats[:, j] for j, n in enumerate(q.STATISTICS)}
    assert s["upper"][0] == pytest.approx(2 / 17) and s["repeated_lines"][0] == pytest.approx(1 / 4) and s["echoed_words"][0] == pytest.approx(2 / 6)
    assert s["pipes"].tolist() == [0, 0, pytest.approx(1 / 3)] and s["distinct_words"][0] == pytest.approx(4 / 6)


def test_held_out_accuracy_and_contract(spark):
    rows = [(i, *c) for i, c in enumerate(corpus(1, 700))]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y, 0) for i, _, y in rows], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in q.judge(docs, labels).collect()}
    assert len(got) == 700 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    held = [i for i, r in got.items() if r.held_out]
    assert sum(got[i].predicted == rows[i][2] for i in held) / len(held) > 0.95
    # labels of held-out rows don't matter
    flipped = labels.selectExpr("doc_id", "if(crc32(encode(string(doc_id), 'UTF-8')) % 5 = 0, 1 - quality, quality) as quality")
    assert {r.doc_id: r.score for r in q.judge(docs, flipped).collect()} == {i: r.score for i, r in got.items()}


def test_odd_rows(spark):
    rows = [(1, "Some text.", 1.5), (1, "Some text.", 1.5), (2, None, 0.1), (3, "", 0.2), (None, "x" * 100_000, 0.3), (4, "a " * 50_000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, Score double").selectExpr("*", "'s' as source")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, None), (None, 1), (4, 7), (99, 0)], "doc_id long, quality int")
    got = q.judge(df, labels).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)
    assert all(r.score == pytest.approx(0.5) for r in q.judge(df, labels.limit(0)).collect())
    assert q.judge(df.limit(0), labels).count() == 0
    machine = q.train(df, labels, metadata=["source"])
    assert q.classify(df, machine, metadata=["source"]).columns == ["doc_id", "text", "source", "score", "predicted"]


def test_the_sample_is_bounded_and_full(spark, monkeypatch):
    """2,000 documents among 100,000 labels fill all places, and one id 20,000 times takes no more than its distinct texts."""
    docs = spark.range(2_000).selectExpr("id * 50 as doc_id", "concat('word', id) as text").unionByName(spark.range(20_000).selectExpr("8L as doc_id", "concat('copy ', id % 3) as text"))
    labels = spark.range(100_000).selectExpr("id as doc_id", "int(id % 2) as quality")
    kept = []
    monkeypatch.setattr(q, "fit", lambda f, y, meta=None: kept.append((len(y), len(f.stats))))
    for most in (1_000, 4_000):
        q.train(docs, labels, max_rows=most)
    q.train(docs, labels, max_rows=4_000, max_bytes=200_000)
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    whole = sum(not held(i) for i in range(0, 100_000, 50)) + (0 if held(8) else 3)
    assert kept[:2] == [(1_000, 1_000), (whole, whole)] and 0 < kept[2][0] < 2_000
