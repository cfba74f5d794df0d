import uuid

from pyspark.sql import functions as F

from textloom.functions import text as t
from textloom.operators import cleaning
from textloom.streaming import stages

GOOD = "We present a careful study of river stones and it shows how water moves them along the bed over many long seasons of rain. "
ROWS = [(1, GOOD, "2024-01-01 00:00:00"), (2, GOOD.upper(), "2024-01-01 00:01:00"), (3, "short", "2024-01-01 00:02:00"), (4, GOOD[:-12] + "of snow. ", "2024-01-01 00:03:00"), (5, "Other text altogether.", "2024-01-01 02:00:00")]


def stream(spark, tmp_path):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, at string").withColumn("ts", F.to_timestamp("at")).drop("at")
    path = f"file://{tmp_path}/{uuid.uuid4().hex}"
    df.coalesce(1).write.parquet(path)
    return spark.readStream.schema(df.schema).parquet(path), df


def drained(spark, df, mode="append"):
    name = f"q{uuid.uuid4().hex}"
    df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start().awaitTermination()
    return spark.table(name).collect()


def test_rules_hold_for_streams(spark, tmp_path):
    live, batch = stream(spark, tmp_path)
    want = {r.doc_id: r.removal_reason for r in cleaning.classify(batch).collect()}
    assert {r.doc_id: r.removal_reason for r in drained(spark, stages.classify_stream(live))} == want


def test_first_of_duplicates(spark, tmp_path):
    live, _ = stream(spark, tmp_path)
    ids = {r.doc_id for r in drained(spark, stages.first_of_duplicates(live, "ts"))}
    assert {3, 4, 5} < ids and len(ids & {1, 2}) == 1


def test_near_duplicates_with_state(spark, tmp_path):
    live, batch = stream(spark, tmp_path)
    got = {r.id for r in drained(spark, stages.near_duplicate_stream(live)) if r.dropped}
    clean = batch.select("doc_id", t.clean_text(F.col("text")).alias("clean_text"))
    alone = {r.doc_id for r in cleaning.near_duplicates(clean).collect()}
    assert got == alone and got


def test_windowed_counts(spark, tmp_path):
    live, _ = stream(spark, tmp_path)
    own = live.select("ts", F.lit("a").alias("event_type"), F.col("doc_id").cast("double").alias("value"))
    rows = {r.window.start.hour: (r.n, r.total) for r in drained(spark, stages.windowed_counts(own), "complete")}
    assert rows == {0: (4, 10.0), 2: (1, 5.0)}
