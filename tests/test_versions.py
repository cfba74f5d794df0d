import os
import threading

import pytest
from pyspark.sql import functions as F

from textloom.sources import versions as v


def ids(df):
    return sorted(r.id for r in df.collect())


def test_overwrite_is_published_whole(spark, tmp_path):
    path = f"{tmp_path}/t"
    assert v.read(spark, path) is None and v.batches(spark, path) == []
    assert v.overwrite(spark.range(5), path) == 1
    boom = spark.range(9).select(F.when(F.col("id") == 7, F.raise_error(F.lit("killed"))).otherwise(F.col("id")).cast("long").alias("id"))
    with pytest.raises(Exception, match="killed"):
        v.overwrite(boom, path)
    assert ids(v.read(spark, path)) == [0, 1, 2, 3, 4]
    old = v.read(spark, path)
    assert v.overwrite(spark.range(10, 12), path) == 2
    assert ids(v.read(spark, path)) == [10, 11] and ids(old) == [0, 1, 2, 3, 4] and ids(v.read(spark, path, 1)) == [0, 1, 2, 3, 4]
    assert v.vacuum(spark, path) == 2 and ids(v.read(spark, path)) == [10, 11] and len(os.listdir(f"{path}/data")) == 1


def test_killed_before_the_rename(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/t"
    v.append(spark.range(3), path, "a")
    monkeypatch.setattr(v._Store, "publish", lambda *_: (_ for _ in ()).throw(KeyboardInterrupt()))
    for write in (lambda: v.append(spark.range(3, 5), path, "b"), lambda: v.overwrite(spark.range(99), path)):
        with pytest.raises(KeyboardInterrupt):
            write()
    monkeypatch.undo()
    assert ids(v.read(spark, path)) == [0, 1, 2] and v.batches(spark, path) == ["a"]
    assert v.append(spark.range(3, 5), path, "b") and not v.append(spark.range(3, 5), path, "b")
    assert ids(v.read(spark, path)) == [0, 1, 2, 3, 4] and v.vacuum(spark, path, keep=2) == 2


def test_a_rerun_does_what_is_pending(spark, tmp_path):
    path, ran = f"{tmp_path}/t", []

    def stage(df):
        ran.append(df.count())
        if len(ran) == 3:
            raise RuntimeError("killed")
        return df

    with pytest.raises(RuntimeError):
        v.resume(spark.range(40), stage, path, "id", parts=4)
    assert len(v.batches(spark, path)) == 2
    assert v.resume(spark.range(40), stage, path, "id", parts=4) == 2 and v.resume(spark.range(40), stage, path, "id", parts=4) == 0
    assert ids(v.read(spark, path)) == list(range(40)) and len(ran) == 5 and sum(ran) - ran[2] == 40


def test_writers_side_by_side(spark, tmp_path):
    path = f"{tmp_path}/t"
    own = [threading.Thread(target=v.append, args=(spark.range(k * 10, k * 10 + 3), path, f"b{k}")) for k in range(5)]
    for t in own:
        t.start()
    for t in own:
        t.join()
    assert sorted(v.batches(spark, path)) == [f"b{k}" for k in range(5)] and len(ids(v.read(spark, path))) == 15
    store = v._Store(spark, path)
    with pytest.raises(v.Conflict):
        store.publish(3, {})
