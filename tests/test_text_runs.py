"""Text functions go by runs and find their parts once, with the results of the plain definitions."""

import re

from pyspark.sql import functions as F

from textloom.functions import text as t

ODD = [" a  b\t c\n\n", " x   y\u0085 z\x1c", "Ã©tÃ© â€“ ï»¿x", "a-b 'c' d_e é1 ab9 9ab a'", "\x0b\x0c  ", "", None, "x́ á b", "  a  b ", "A-- b' $1 $ab$ a b"]


def test_normal_form_in_one_replacement(spark):
    df = spark.createDataFrame([(x,) for x in ODD], "x string")
    form = df.select("x", t.duplicate_form(F.col("x")).alias("form"))
    for r in form.collect():
        assert r.form == (None if r.x is None else re.sub(r"\s+", " ", re.sub(r"[^a-z0-9\s]", " ", r.x.lower(), flags=re.ASCII), flags=re.ASCII).strip(" "))
    assert form._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") == 1


def test_squeeze_is_split_and_join(spark):
    df = spark.createDataFrame([(x,) for x in ODD], "x string")
    for r in df.select("x", t.squeeze(F.col("x")).alias("s")).collect():
        assert r.s == (None if r.x is None else " ".join(r.x.split()))


def test_parts_of_a_text_are_found_once(spark):
    """Each chunk cut the whole text into sentences again; now the cut stands once in the plan's expression, outside the lambda over places."""
    df = spark.createDataFrame([(". ".join(f"s{i}" for i in range(45)),), ("",), (None,)], "x string")
    parts = t.sentences(F.col("x"))
    for own in (t.chunks(parts, 20), t.even_subset(parts, 7), t.windows(parts, 20)):
        assert df.select(own.alias("y"))._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
    got = df.select(t.chunks(parts, 20).alias("c"), t.even_subset(parts, 7).alias("e")).collect()
    assert [len(c) for c in got[0].c] == [20, 20, 5] and len(got[0].e) == 7
    assert got[0].e == [got[0].c[int(i * (45 / 7)) // 20][int(i * (45 / 7)) % 20] for i in range(7)]
    assert got[1].c == [] and got[1].e == [] and got[2].e is None
