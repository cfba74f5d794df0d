from pyspark.sql import functions as F

from textloom.functions import bitmaps


def test_no_row_with_a_key_is_lost_and_few_others_stay(spark):
    rows = spark.range(60_000).selectExpr("id", "if(id % 1000 = 999, null, id) as k")
    for n in (0, 1, 1000, 20_000):
        keys = spark.range(n).selectExpr("id * 7 as of")
        got = bitmaps.among(rows, F.col("k"), keys, n)
        want = {i for i in range(0, min(60_000, 7 * n), 7) if i % 1000 != 999}
        ids = [r.id for r in got.collect()]
        assert got.columns == ["id", "k"] and len(set(ids)) == len(ids) and want <= set(ids) and len(ids) - len(want) <= 60_000 / bitmaps.EACH * 1.2
    assert bitmaps.size(10**9) == bitmaps.MAX_BITS and bitmaps.size(0) == 10


def test_a_full_bitmap_keeps_all(spark, monkeypatch):
    monkeypatch.setattr(bitmaps, "MAX_BITS", 10)
    rows = spark.range(3000)
    got = {r.id for r in bitmaps.among(rows, F.col("id"), spark.range(0, 6000, 2), 3000).collect()}
    assert set(range(0, 3000, 2)) <= got
