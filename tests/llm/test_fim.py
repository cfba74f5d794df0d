import hashlib
import random
import re

import duckdb
import pytest

from textloom.llm import fim


def plain(text, doc_id, rule=fim.Rule()):
    """The same by the re module and without offsets."""
    p, s, m = rule.sentinels
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(lines)
    hexa = hashlib.sha256(f"{rule.seed}:{doc_id}".encode()).hexdigest()
    h = [int(hexa[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not text or p in text or s in text or m in text or h[2] % 100 >= rule.rate:
        return text, "plain", n, None, None
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    pre, mid, suf = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    if h[3] % 100 < rule.spm_rate:
        return s + suf + p + pre + m + mid, "spm", n, len(pre), len(mid)
    return p + pre + s + suf + m + mid, "psm", n, len(pre), len(mid)


def texts(seed=3, n=300):
    r = random.Random(seed)
    own = ["", "\n", "\n\n\n", "a", "é\r\n x\n", "<P", "<P>", "a<S\n>b<", "<M>", "<<P\nM>", "\x00\n\x00", "\U0001f600\n\U0001f600", "a\n" * 500]
    return own + ["".join(r.choice("aé\n <>PSM\U0001f600\r") for _ in range(r.randrange(60))) for _ in range(n)]


def test_against_lines_by_re(spark):
    rows = [(i, t) for i, t in enumerate(texts())]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = fim.transform(df).withColumn("again", fim.restore(fim.F.col("output"), fim.F.col("form"))).collect()
    assert {r.form for r in got} == {"plain", "psm", "spm"} and len(got) == len(rows)
    for r in got:
        assert (r.output, r.form, r.n, r.prefix_chars, r.middle_chars) == plain(r.text, r.doc_id)
        assert r.again == r.text


def test_rates_and_sentinels(spark):
    rule = fim.Rule(seed=1, rate=40, spm_rate=0, sentinels=("[pre]", "[suf]", "[mid]"))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts(4))], "doc_id long, text string")
    for r in fim.transform(df, rule).withColumn("again", fim.restore(fim.F.col("output"), fim.F.col("form"), rule)).collect():
        assert (r.output, r.form, r.n, r.prefix_chars, r.middle_chars) == plain(r.text, r.doc_id, rule) and r.again == r.text
    for bad in (("ab", "bc", "x"), ("aa", "b", "c"), ("a", "a", "b"), ("abc", "b", "x"), ("", "a", "b")):
        with pytest.raises(ValueError):
            fim.Rule(sentinels=bad)


def test_stretches_are_exact():
    r = random.Random(5)
    split = fim.splitter()
    for _ in range(200):
        t = "".join(r.choice("ab\n") for _ in range(r.randrange(80)))
        assert "".join(p for _, p in fim.stretches(t, 7)) == t and all(p.endswith("\n") or at + len(p) == len(t) for at, p in fim.stretches(t, 7))
    long = "x" * 3_000_000 + "\n" + "y\n" * 300_000
    ends = fim.unit_ends(long, split)
    assert len(ends) == 300_001 and ends[0] == 3_000_001 and ends[-1] == len(long)


def test_sql(spark):
    rows = [(i, t) for i, t in enumerate(texts()) if "\x00" not in t] + [(-5, "a\nb"), (9, None), (9, "x\ny\n"), (9, "x\ny\n")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = fim.digests(df)
    con = duckdb.connect()
    con.register("documents", df.toArrow())
    want = con.execute(fim.oracle_sql())
    names = [c[0] for c in want.description]
    assert sorted(map(str, got.select(*names).collect())) == sorted(str(got.select(*names).collect()[0].__class__(**dict(zip(names, w)))) for w in want.fetchall())
    assert got.where("restored_sha256 is null or output_sha256 is null").count() == 0


def test_odd_rows(spark):
    df = spark.createDataFrame([(None, "a\nb\n", 1), (1, None, 2), (1, "", 3), (2, "q" * 200_000 + "\n" + "z", 4)], "doc_id long, text string, Form int").selectExpr("*", "'k' as extra")
    got = fim.transform(df).collect()
    assert fim.transform(df).columns == ["doc_id", "text", "extra", *fim.MADE] and len(got) == 4
    assert [(r.output, r.form, r.n) for r in got if r.doc_id == 1] == [("", "plain", 0)] * 2
    assert fim.digests(df.limit(0)).count() == 0
    again = fim.digests(df).collect()
    assert {r.restored_sha256 for r in again if r.doc_id == 2} == {hashlib.sha256(("q" * 200_000 + "\nz").encode()).hexdigest()}
