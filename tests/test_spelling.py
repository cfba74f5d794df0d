import random
import re
from collections import Counter

from textloom.operators import spelling as sp

from .shuffles import shuffled


def cut(text):
    return re.findall(r"[^\W\d_]+(?:['’][^\W\d_]+)*", (text or "").lower())


def apart(a, b):
    """One insertion, deletion, substitution or swap of neighbours, by trying all edits."""
    letters = set(b)
    edits = {a[:i] + a[i + 1 :] for i in range(len(a))} | {a[:i] + c + a[i + 1 :] for i in range(len(a)) for c in letters} | {a[:i] + c + a[i:] for i in range(len(a) + 1) for c in letters}
    return b != a and b in edits | {a[:i] + a[i + 1] + a[i] + a[i + 2 :] for i in range(len(a) - 1)}


def plain(rows, known, sure, least):
    texts = [(i, cut(t)) for i, t in rows]
    n = Counter(w for _, t in texts for w in t)
    k = Counter(p for _, t in texts for p in zip(t, t[1:]))
    out = []
    for i, t in texts:
        for at, w in enumerate(t):
            if n[w] >= known or len(w) < least:
                continue
            tried = []
            for c in n:
                if n[c] >= known and apart(w, c):
                    context = (k[t[at - 1], c] if at else 0) + (k[c, t[at + 1]] if at + 1 < len(t) else 0)
                    tried.append((-context, -n[c], c))
            if tried and (min(tried)[0] < 0 or -min(tried)[1] >= sure * n[w]):
                context, m, c = min(tried)
                out.append((i, at, w, c, -context, -m))
    return sorted(out, key=str)


def typo(r, w):
    k = r.randrange(len(w) - 1)
    return r.choice([w[:k] + w[k + 1] + w[k] + w[k + 2 :], w[:k] + w[k + 1 :], w[:k] + r.choice("xyzq") + w[k + 1 :], w[:k] + r.choice("xyzq") + w[k:]])


def corpus(seed, n=150):
    """Sentences over a small grammar, so that words have neighbours of their own; one word in 40 is mistyped. (rows, planted)"""
    r = random.Random(seed)
    noun, verb, adjective = "garden window teacher castle letter müller bridge market".split(), "watches builds remembers forgets paints carries".split(), "yellow ancient quiet narrow friendly d'autres".split()
    rows, planted = [], []
    for i in range(n):
        w = []
        for _ in range(r.randrange(1, 12)):
            w += ["the", r.choice(adjective), r.choice(noun), r.choice(verb), "the", r.choice(noun)]
        for at, x in enumerate(w):
            if len(x) > 4 and "'" not in x and r.random() < 0.025:
                w[at] = typo(r, x)
                if w[at] != x:
                    planted.append((i, at, x))
        rows.append((i, " ".join(w).capitalize() + "."))
    return rows, planted


def test_against_plain(spark):
    rows, _ = corpus(1)
    rows += [(900, None), (901, ""), (902, "Gardne"), (903, "the qqqq wwww"), (None, "the ancient gadren watches")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).selectExpr("*", "'z' as word", "1 as place")
    got = sorted((tuple(x) for x in sp.corrections(df).select("doc_id", "place", "word", "correction", "context", "m").collect()), key=str)
    assert got == plain(rows, sp.KNOWN, sp.SURE, sp.MIN_LETTERS) and len(got) > 20
    assert sp.corrections(df.limit(0)).count() == 0 and sp.corrections(df.where("doc_id = 902")).count() == 0


def test_planted_typos_are_found(spark):
    rows, planted = corpus(2, 400)
    found = sp.corrections(spark.createDataFrame(rows, "doc_id long, text string"))
    row = sp.scored(found, spark.createDataFrame(planted, "doc_id long, place int, right string")).first()
    assert row.planted > 100 and row.recall > 0.95 and row.precision > 0.97


def test_close_words(spark):
    r = random.Random(3)
    words = ["".join(r.choice("abc") for _ in range(r.randrange(1, 6))) for _ in range(60)] + ["rereat", "ererat"]
    pairs = [(a, b) for a in words for b in words]
    df = spark.createDataFrame(pairs, "a string, b string")
    got = {(x.a, x.b): x.y for x in df.select("a", "b", sp.close(df.a, df.b).alias("y")).collect()}
    assert got == {(a, b): apart(a, b) for a, b in pairs}


def test_no_pair_without_a_deletion_in_common(spark):
    df = spark.createDataFrame([("garden", 9), ("gadren", 1), ("window", 9), ("wimdow", 1)], "word string, n long")
    plan = sp.candidates(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "Cross" not in plan and {(x.word, x.candidate) for x in sp.candidates(df).collect()} == {("gadren", "garden"), ("wimdow", "window")}


def test_only_what_is_looked_up_is_shuffled(spark):
    """Of 120,000 occurrences in 80,000 different pairs, 30 are of unknown words."""
    r = random.Random(7)
    known = sorted({"".join(r.choice("abcdefghijklmnop") for _ in range(9)) for _ in range(300)})
    rows = [(i, " ".join(r.choice(known) for _ in range(40)) + (" " + typo(r, known[i]) + " " + known[0] if i < 30 else "")) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).cache()
    df.count()
    got = []
    assert shuffled(spark, lambda: got.extend(tuple(x) for x in sp.corrections(df).select("doc_id", "place", "word", "correction", "context", "m").collect())) < 700_000
    assert sorted(got, key=str) == plain(rows, sp.KNOWN, sp.SURE, sp.MIN_LETTERS) and len(got) > 10
