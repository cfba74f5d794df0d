"""Python steps hold slices of bounded size, whatever the size of their batches."""

import pyarrow as pa

from textloom.functions import batches
from textloom.operators import judging


def test_slices_hold_every_row_once():
    texts = ["a" * 300, None, "", "b" * 5000, "c", "d" * 400, "é" * 300]
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(texts)], names=["i", "x"])
    parts = list(batches.slices(batch, "x", 1000))
    assert [v for p in parts for v in p.column("i").to_pylist()] == list(range(7))
    assert [len(p) for p in parts] == [3, 1, 2, 1]
    lists = pa.array([["a" * 600, None], None, [], ["b" * 600], ["c"]])
    batch = pa.RecordBatch.from_arrays([pa.array(range(5)), lists], names=["i", "x"])
    assert [len(p) for p in batches.slices(batch, "x", 1000)] == [3, 2]
    assert list(batches.slices(batch.slice(0, 0), "x")) == []


def test_scored_windows_come_from_bounded_slices(spark):
    """A batch of 3000 texts of 2 kB was one list of Python strings of all its words."""

    def scorer():
        seen = []

        def score(windows):
            seen.append(sum(len(w) for w in windows))
            assert len(windows) <= 300  # a slice of 512 kB has 262 texts of one window
            return [0.0] * len(windows)

        return score

    docs = spark.range(3000).selectExpr("id as doc_id", "repeat('a ', 1000) as text").coalesce(1)
    got = judging.perplexity(docs, scorer, window=2000).agg({"n_tokens": "sum", "n_windows": "sum"}).first()
    assert sorted(got) == [3000, 3_000_000]
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")) <= batches.BATCH_BYTES
