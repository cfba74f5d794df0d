"""A bounded sample of labelled documents, brought to the driver as compact rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def labelled_rows(docs: DataFrame, labels: DataFrame, label_col: str, held_out: Callable[[Column], Column], encode: Callable, schema: str, columns: list[str], max_rows: int, max_bytes: int) -> list:
    """At most max_rows rows of at most max_bytes in all: id, y, digest, n_bytes and what `encode` makes of texts.

    Labels of 0 or 1 whose id isn't held out and has a document are taken by the hash of the id, so labels without a document use no place
    up. A document that repeats its id, text and label counts once; documents of one id with different texts count each, and of all
    rows the max_rows with the lowest hashes stay, as far as their bytes fit; a row of more than a 64th of max_bytes isn't trained on.
    encode: of Arrow batches of (id, y, digest, text, *columns) into those of (id, y, digest, n_bytes, *schema); its rows are what is collected.
    """
    known = labels.where(F.col(label_col).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.select(F.col("doc_id").cast("long").alias("__id"), F.col(label_col).cast("int").alias("__y")).distinct()
    has = docs.select(F.col("doc_id").cast("long").alias("__id")).where("__id is not null")
    ids = known.join(has, "__id", "left_semi").orderBy(F.xxhash64("__id"), "__id", "__y").limit(max_rows)
    rows = docs.join(F.broadcast(ids), F.col("doc_id").cast("long") == F.col("__id"))  # at most max_rows pairs of numbers
    rows = rows.select(F.col("__id").alias("id"), F.col("__y").alias("y"), F.xxhash64(F.coalesce(F.col("text"), F.lit("")), *columns).alias("digest"), "text", *columns)
    made = rows.mapInArrow(encode, f"id long, y int, digest long, n_bytes long, {schema}").where(F.col("n_bytes") <= max(1, max_bytes // 64))
    order = [F.xxhash64("id"), F.col("id"), F.col("y"), F.col("digest")]
    names = [c for c in made.columns if c not in ("id", "y", "digest")]
    once = made.groupBy("id", "y", "digest").agg(*[F.first(c).alias(c) for c in names])
    few = once.orderBy(*order).limit(max_rows)
    # one window over at most max_rows rows
    fits = few.withColumn("__sum", F.sum("n_bytes").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))).where(F.col("__sum") <= max_bytes).drop("__sum")
    return sorted(fits.collect(), key=lambda r: (r.id, r.y, r.digest))
