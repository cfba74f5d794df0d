"""Stages of a corpus pipeline: (spark, docs, sf_dir) -> the rows of docs that stay, with the columns of documents.

Every stage takes nulls in any column, empty and very long texts, repeated rows and ids, an empty table and extra columns,
also of names that operators use inside: columns come out as they went in, but for what the last stage adds, and an
empty table stays empty. What becomes of the rows: the classifier scores null and empty texts like all others; near-duplicates
keep rows without an id, without a text and without words (they link with nothing), and of rows that repeat an id one; decontamination and
masking keep null texts, as they hold nothing, and judge each row with a null id by its text; null texts encode to no ids. Texts are worked on in whole.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bpe, decontaminate, near_dup, quality, secret_scan
from .common import ARROW_BYTES, settle, table

#: Ids of dropped documents that are broadcast; with more, a shuffle join drops them.
BROADCAST_IDS = 500_000


def _stage(function):
    """Small Arrow batches for a stage that is called by itself."""

    @wraps(function)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
        return function(spark, docs, sf_dir)

    return run


@_stage
def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier: documents that it rejects go. Trained on the labelled documents of the input; every row is judged by its text."""
    machine = quality.train(docs.select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "quality"))
    return quality.keep_good(docs, machine)


@_stage
def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """MinHash near-dedup, five-word shingles, similarity 0.8: the smallest doc_id of each group stays.

    Of rows that repeat a kept doc_id the one whose text sorts first stays; rows with a null doc_id stay.
    """
    judged = near_dup.near_duplicates(docs, width=5, percent=80).where("doc_id is not null")
    per_id = judged.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.bool_and("kept").alias("kept")).where("n > 1 or not kept")
    odd = settle(per_id, "not-single")
    few = odd.count() <= BROADCAST_IDS
    side = lambda df: F.broadcast(df) if few else df
    single = docs.join(side(odd.select("doc_id")), "doc_id", "left_anti").select(*docs.columns)
    again = docs.join(side(odd.where("kept").select("doc_id")), "doc_id", "left_semi")
    first = Window.partitionBy("doc_id").orderBy(*[F.col(c).asc_nulls_first() for c in docs.columns if c != "doc_id"])
    return single.unionByName(again.withColumn("__n", F.row_number().over(first)).where("__n = 1").select(*docs.columns))


@_stage
def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Template decontamination: documents that leak an item of the benchmark go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))


@_stage
def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secret scan: secrets in the texts are masked; all rows stay."""
    return secret_scan.redact(docs, path=F.col("source"))


@_stage
def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE: adds the ids of each text, how many they are, and digests of the ids and of what they decode to."""
    import public_tokenizers

    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    return bpe.digests(docs, path, pattern, keep_ids=True).drop("text")


STAGES = [
    ("quality classifier", keep_good),
    ("near-duplicates", keep_one_of_near_duplicates),
    ("benchmark decontamination", drop_benchmark_leaks),
    ("secret scan", mask_secrets),
    ("byte-level BPE", tokenise),
]
