import random
import re

import pytest

from textloom.llm import near_dup
from textloom.llm.components import components


def sets(text, width):
    w = re.findall(r"[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def brute(rows, width, percent=80):
    own = [(i, sets(t, width)) for i, t in rows if i is not None]
    up = {i: i for i, _ in own}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, x in own:
        for b, y in own:
            if a < b and x and y and 100 * len(x & y) >= percent * len(x | y):
                up[max(root(a), root(b))] = min(root(a), root(b))
    return sorted((i, len(s), root(i), root(i) == i) for i, s in own)


def corpus(seed, n):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randrange(1, 6)))
    rows, texts = [], []
    for i in range(n):
        if texts and r.random() < 0.6:
            w = r.choice(texts).split(" ")
            for _ in range(r.choice([0, 1, 1, 2, 3, 5, 9])):
                w[r.randrange(len(w))] = word()
            t = " ".join(w)
        else:
            t = " ".join(word() for _ in range(r.choice([1, 2, 3, 4, 8, 40, 120, 300])))
        texts.append(t)
        rows.append((i * 7 % n, t.upper() if r.random() < 0.1 else t))
    return rows


@pytest.mark.parametrize(("seed", "width"), [(1, 4), (2, 5)])
def test_against_all_pairs(spark, seed, width):
    rows = corpus(seed, 260)
    got = sorted(map(tuple, near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width).collect()))
    assert got == brute(rows, width)


def test_a_large_group_around_a_missing_text(spark):
    r = random.Random(5)
    base = [f"w{r.randrange(10**6)}" for _ in range(150)]
    rows = []
    for i in range(300):
        w = list(base)
        for _ in range(r.randrange(1, 9)):
            w[r.randrange(150)] = f"x{r.randrange(10**9)}"
        rows.append((i, " ".join(w)))
    got = sorted(map(tuple, near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()))
    assert got == brute(rows, 4)


def test_a_large_group_of_repeated_rows(spark):
    r = random.Random(5)
    base = [f"w{r.randrange(10**6)}" for _ in range(150)]
    rows = []
    for i in range(120):
        w = list(base)
        for _ in range(r.randrange(1, 9)):
            w[r.randrange(150)] = f"x{r.randrange(10**9)}"
        rows += [(i, " ".join(w))] * (2 if i % 2 else 3)
    rows += [(i, " ".join(f"o{r.randrange(10**6)}" for _ in range(150))) for i in range(0, 120, 4)]  # two texts under one id
    got = set(map(tuple, near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()))
    assert got == set(brute(rows, 4))


def test_masses_of_repeated_rows(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (1, "p q r s t"), (2, "a b c d e g"), (3, "x y z v w"), (3, "x y z v w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    units = near_dup.features(docs, 4).dropDuplicates(["class"]).selectExpr("xxhash64(class) as unit", "doc_id as node", "class", "n_shingles as n")
    got = sorted((r.node, r.n, r.m) for r in near_dup.masses(docs, units, 4).collect())
    assert got == [(1, 2, 0), (1, 3, 2), (2, 3, 2), (3, 2, 0)]


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One two"), (5, "one  TWO"), (6, "one two three"), (6, "one two three"), (7, "É a b c d"), (8, "é a b c d"), (None, "one two"), (9, "w " * 20_000), (10, "w w w w w"), (11, "w w w w")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as node", "2 as class", "3 as component")
    got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dup.near_duplicates(df, 4).collect()}
    assert got == {(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False), (6, 1, 6, True), (7, 2, 7, True), (8, 2, 8, True), (None, 1, None, True), (9, 1, 9, True), (10, 1, 9, False), (11, 1, 9, False)}
    assert near_dup.near_duplicates(df.limit(0)).count() == 0


def test_oracle(spark, tmp_path):
    import duckdb

    rows = [*corpus(3, 120), (500, None), (501, ""), (502, "One two"), (503, "one  two"), (503, "one two three four five"), (None, "one two")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    df.write.parquet(f"{tmp_path}/documents")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents/*.parquet'")
    want = con.execute(f"select doc_id, n_shingles, component_id, kept from ({near_dup.oracle_sql(4, 80)})").fetchall()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in near_dup.near_duplicates(df, 4).collect())


def test_components(spark):
    r = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, x) for x in range(101, 150)] + [(200 + r.randrange(80), 200 + r.randrange(80)) for _ in range(60)] + [(5, 5)]
    up = {x: x for e in edges for x in e}
    for _ in range(300):
        for a, b in edges:
            up[a] = up[b] = min(up[a], up[b])
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {x: c for x, c in up.items() if x in got} and all(x == c for x, c in up.items() if x not in got)


def test_matches_follow_from_the_similarity():
    from math import comb

    from textloom.llm import near_dup as n

    miss = lambda m, p: sum(comb(n.COORDINATES, k) * p**k * (1 - p) ** (n.COORDINATES - k) for k in range(m))
    for percent in (30, 50, 80, 95, 100):
        m = n.matches_for(percent)
        assert miss(m, percent / 100) <= n.MISS < (miss(m + 1, percent / 100) if m < n.COORDINATES else 1)
    assert n.matches_for(80) == 22
    with pytest.raises(ValueError):
        n.matches_for(10)


def test_pairs_of_half_similarity(spark):
    r = random.Random(8)
    rows = []
    for g in range(40):
        w = [f"g{g}w{k}" for k in range(90)]
        rows += [(2 * g, " ".join(w[:60])), (2 * g + 1, " ".join(w[r.randrange(16, 21) :][: 62]))]
    got = {x.doc_id: x.component_id for x in near_dup_of(spark, rows, 50)}
    for g in range(40):
        a, b = (set(zip(*[t.split()[k:] for k in range(4)])) for _, t in rows[2 * g : 2 * g + 2])
        assert (got[2 * g] == got[2 * g + 1]) == (100 * len(a & b) >= 50 * len(a | b))
    assert 0 < sum(got[2 * g] == got[2 * g + 1] for g in range(40)) < 40


def near_dup_of(spark, rows, percent):
    from textloom.llm import near_dup as n

    return n.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=4, percent=percent).collect()
