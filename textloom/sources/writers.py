"""Sinks with audit, resume and counters. Spark's committers make a write whole or absent."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_audited(kept: DataFrame, removed: DataFrame, path: str) -> None:
    """kept and removed beside each other; removed rows carry their reason."""
    kept.write.mode("overwrite").parquet(f"{path}/kept")
    removed.write.mode("overwrite").partitionBy("removal_reason").parquet(f"{path}/removed")


def write_splits(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").partitionBy("split").parquet(path)


def pending(inputs: DataFrame, done: DataFrame, key: str, failed: str | None = None) -> DataFrame:
    """The inputs without a finished output; outputs for which the SQL condition `failed` holds are done again."""
    finished = done if failed is None else done.where(f"not coalesce({failed}, false)")
    return inputs.join(finished.select(key).distinct(), key, "left_anti")


def append_missing(inputs: DataFrame, stage, path: str, key: str, failed: str | None = None) -> int:
    """Runs stage over what is pending at path and appends its output; returns how many rows were pending. A path without files has nothing done."""
    spark = inputs.sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = place.getFileSystem(spark._jsc.hadoopConfiguration())
    written = store.exists(place) and any(not f.getPath().getName().startswith(("_", ".")) for f in store.listStatus(place))
    todo = pending(inputs, spark.read.parquet(path), key, failed) if written else inputs
    n = todo.count()
    if n:
        stage(todo).write.mode("append").parquet(path)
    return n


def run_counts(df: DataFrame, status: str = "status") -> DataFrame:
    return df.groupBy(status).agg(F.count(F.lit(1)).alias("n"))
