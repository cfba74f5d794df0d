import random
import zlib

import numpy as np
import pytest

from textloom.llm import toxicity as t

from ..shuffles import shuffled


def pack(texts):
    raw = [x.encode() for x in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)


def corpus(seed, n, bad=("grobian", "fiesling", "schuft")):
    """Texts of plain words; a toxic one has a few ill words, some with an ending that training may not have seen."""
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdefghij") for _ in range(r.randrange(2, 8))) for _ in range(400)]
    out = []
    for _ in range(n):
        w = [r.choice(vocab) for _ in range(r.randrange(0, 150))]
        toxic = int(r.random() < 0.25)
        for _ in range(toxic * r.randrange(1, 4)):
            w.insert(r.randrange(len(w) + 1), (r.choice(bad) + r.choice(["", "", "en", "ere" + r.choice(vocab)])).title())
        out.append((" ".join(w), toxic, r.choice(["de", "en", None])))
    return out


def plain_score(net, text):
    """One window at a time."""
    low = [x for x in "".join(chr(b).lower() if chr(b).isascii() and chr(b).isalnum() else (chr(b) if b >= 128 else " ") for b in text.encode()).split(" ") if x]
    rows = []
    for x in low:
        raw = np.frombuffer(bytes(map(ord, x)), np.uint8)
        _, b = t.encode(raw, np.array([0, len(raw)]))
        rows.append(sum(net.embed[i].astype(float) for i in b[0]))
    rows += [np.zeros(t.SIZE)] * (t._REACH + (not rows))
    best = []
    for w, k in zip(t.WIDTHS, net.kernels):
        acts = [sum(rows[i + j] @ k[j] for j in range(w)) for i in range(len(rows) - t._REACH)]
        best.append(np.max(acts, axis=0))
    z = net.base + np.maximum(np.concatenate(best) + net.bias, 0) @ net.out
    return 1 / (1 + np.exp(-z))


def some_net(seed=1):
    net = t.empty_net(0.3, seed)
    net.embed *= 40
    net.embed[t._PAD] = 0
    net.bias = np.random.default_rng(2).standard_normal(len(net.bias)).astype(np.float32) * 0.3
    net.out = np.random.default_rng(3).standard_normal(len(net.out)).astype(np.float32) * 0.1
    return net


def test_score_is_the_net_window_by_window(monkeypatch):
    net = some_net()
    r = random.Random(4)
    texts = ["", "A", "a b", "é-x É,x!! 12", " \n", "a" * 400] + [" ".join(r.choice(["Ab", "c", "d9", "ünï", "#"]) for _ in range(r.randrange(40))) for _ in range(40)]
    want = [plain_score(net, x) for x in texts]
    assert t.score(net, *pack(texts)) == pytest.approx(want, abs=1e-5)
    monkeypatch.setattr(t, "STEP", 7)
    assert t.score(net, *pack(texts)) == pytest.approx(want, abs=1e-5)


def test_long_texts_in_stretches():
    net = some_net()
    r = random.Random(5)
    for _ in range(60):
        text = " ".join("".join(r.choice("abc") for _ in range(r.randrange(1, 9))) for _ in range(r.randrange(1, 60)))
        data, offsets = pack([text])
        assert t._long(net, data, 16) == pytest.approx(t.pooled(net, *t.encode(data, offsets), 1)[0], abs=1e-5)
    long = "word other " * 150_000
    assert t.score(net, *pack([long]))[0] == pytest.approx(t.score(net, *pack(["word other " * 50]))[0], abs=1e-5)


def test_gradients():
    """A step of the fit lowers the loss along what finite differences say: the net learns a word that it hasn't seen in training by its beginning."""
    rows = corpus(6, 400)
    data, offsets = pack([x for x, _, _ in rows])
    row, buckets = t.encode(data, offsets)
    own = t.Rows(buckets, np.searchsorted(row, np.arange(len(rows) + 1)), np.array([y for _, y, _ in rows], np.float32))
    net = t.fit(own, np.arange(len(rows)))
    loss = lambda n: float(np.mean([-np.log(p if y else 1 - p) for p, (_, y, _) in zip(t.score(n, data, offsets), rows)]))
    assert loss(net) < 0.3 * loss(t.fit(own, np.arange(len(rows)), epochs=0))
    new = t.score(net, *pack(["abc def grobianabcj hij", "abc def abcgrobi hij"]))
    assert new[0] > 0.5 > new[1]


def test_held_out_accuracy_contract_and_calibration(spark):
    rows = [(i, *c) for i, c in enumerate(corpus(7, 1200))]
    docs = spark.createDataFrame([(i, x, g) for i, x, _, g in rows], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, y, 0) for i, _, y, _ in rows], "doc_id long, toxic int, quality int")
    got = {r.doc_id: r for r in t.judge(docs, labels).collect()}
    assert len(got) == 1200 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) and r.flagged == (r.score >= r.lang_threshold) for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    held = [i for i, r in got.items() if r.held_out]
    assert sum(got[i].predicted == rows[i][2] for i in held) / len(held) > 0.95
    assert sum(got[i].flagged == rows[i][2] for i in held) / len(held) > 0.95
    pairs = {(rows[i][3], r.lang_threshold) for i, r in got.items()}
    assert len(pairs) == 3 and len({c for _, c in pairs}) > 1
    # neither labels of held-out rows nor languages change a score
    flipped = labels.selectExpr("doc_id", "if(crc32(encode(string(doc_id), 'UTF-8')) % 4 = 2, 1 - toxic, toxic) as toxic")
    other = docs.selectExpr("doc_id", "text", "'xx' as lang")
    assert {r.doc_id: r.score for r in t.judge(other, flipped).collect()} == {i: r.score for i, r in got.items()}


def test_best_cut():
    s, y = np.array([0.9, 0.8, 0.8, 0.5, 0.1]), np.array([1, 1, 0, 0, 0])
    assert t.best_cut(s, y) == pytest.approx(0.65)
    assert t.best_cut(np.array([0.4, 0.2]), np.array([1, 1])) == pytest.approx(0.1)


def test_odd_rows(spark):
    rows = [(1, "Some text.", 1.5), (1, "Some text.", 1.5), (2, None, 0.1), (3, "", 0.2), (None, "x" * 2_000_000, 0.3), (4, "a " * 50_000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, Score double")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, None), (None, 1), (4, 7), (99, 0)], "doc_id long, toxic int")
    got = t.judge(df, labels).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)
    assert all(r.score == pytest.approx(0.5) for r in t.judge(df, labels.limit(0)).collect())
    assert t.judge(df.limit(0), labels).count() == 0
    net = t.train(df, labels)
    assert t.classify(df.withColumn("lang", df.text), net).columns == ["doc_id", "text", "lang", "score", "predicted", "lang_threshold", "flagged"]


def test_the_sample_is_bounded_and_full(spark):
    """One id 20,000 times, and many labels without a document, leave all places to rows that count."""
    docs = spark.range(300).selectExpr("id as doc_id", "concat('word', id) as text").unionByName(spark.range(20_000).selectExpr("7L as doc_id", "concat('copy ', id % 2) as text"))
    labels = spark.range(100_000).selectExpr("id * 3 as doc_id", "int(id % 2) as toxic").unionByName(spark.createDataFrame([(7, 1)], "doc_id long, toxic int"))
    kept = []
    real = t.fit
    t.fit = lambda rows, which, **k: kept.append(len(which)) or real(rows, which, epochs=0)
    try:
        t.train(docs, labels, max_rows=60)
        t.train(docs, labels, max_rows=4_000)
    finally:
        t.fit = real
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    assert kept[0] == 60 and kept[3] == sum(not held(i) for i in range(0, 300, 3)) + (0 if held(7) else 3)


def test_every_labelled_row_is_learned_from(spark):
    """A word that only rows beyond the start's bound have is learned; cuts come from all rows."""
    start = [(i, x, y, g) for i, (x, y, g) in enumerate(corpus(9, 3000))]
    more = [(i + 3000, x + (" zwergnase" if y else ""), y, g) for i, (x, y, g) in enumerate(corpus(10, 3000, bad=("zwergnase", "zwerghut")))]
    docs = spark.createDataFrame([(i, x, g) for i, x, _, g in start + more], "doc_id long, text string, lang string").repartition(3)
    labels = spark.createDataFrame([(i, y) for i, _, y, _ in start + more], "doc_id long, toxic int")
    net = t.train(docs, labels, max_rows=100)
    few = t.train(docs.where("doc_id < 100"), labels)
    hit = lambda n: float(np.mean([(s >= 0.3) == y for s, (_, _, y, _) in zip(t.score(n, *pack([x for _, x, _, _ in more])), more)]))
    assert hit(net) > max(0.9, hit(few)) and {"de", "en"} <= set(net.cuts)


def test_cuts_of_counts():
    r = np.random.default_rng(11)
    s, y = np.round(r.random(400), 2), r.integers(0, 2, 400)
    own, at = np.unique(s, return_inverse=True)
    assert t.best_cut_of_counts(own, np.bincount(at, y), np.bincount(at)) == pytest.approx(t.best_cut(s, y))


def test_texts_without_a_label_are_not_shuffled(spark, request):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    request.addfinalizer(lambda: spark.conf.unset("spark.sql.autoBroadcastJoinThreshold"))
    docs = spark.range(4000).selectExpr("id as doc_id", "concat_ws(' ', transform(sequence(1, 40), i -> md5(string(id * 100 + i)))) as text", "'de' as lang").repartition(3).cache()
    docs.count()
    labels = spark.createDataFrame([(i, int(i % 3 == 0) if i % 40 == 0 else None) for i in range(8000)], "doc_id long, toxic int")
    rows = t._labelled(docs, labels, "toxic")
    assert shuffled(spark, lambda: rows.write.format('noop').mode('append').save()) < 4000 * 40 * 32 / 10
    want = {i for i in range(0, 4000, 40) if zlib.crc32(str(i).encode()) % 4 != 2}
    assert {(r.id, r.y) for r in rows.collect()} == {(i, int(i % 3 == 0)) for i in want} and all(len(r.text) == 40 * 33 - 1 for r in rows.collect())
