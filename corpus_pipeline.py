"""A training-data pipeline over `documents`: quality, near-duplicates, benchmark leaks, secrets, tokens.

What the stages do with nulls, empty and long texts, repeated rows, empty tables and clashing names stands in
textloom/llm/stages.py. Each works on all that the one before it kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from textloom.llm.common import settle, table
from textloom.llm.stages import STAGES

#: No SQL can express the classifier's and the forest's fits; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to documents; each stage reads what the one before it wrote."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
