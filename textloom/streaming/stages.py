"""The stateless cleaning rules and windowed aggregates over streams."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import text as t
from ..operators.cleaning import CleanConfig, classify


def classify_stream(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """classify() holds for streams as it stands: every rule looks at one row."""
    assert docs.isStreaming
    return classify(docs, text_col)


def first_of_duplicates(docs: DataFrame, time_col: str, delay: str = "1 hour", text_col: str = "text") -> DataFrame:
    """Exact duplicates of the normal form go if the first came within the watermark's delay."""
    keyed = docs.withColumn("form", F.md5(t.duplicate_form(F.col(text_col))))
    return keyed.withWatermark(time_col, delay).dropDuplicatesWithinWatermark(["form"])


def windowed_counts(events: DataFrame, time_col: str = "ts", delay: str = "10 minutes", width: str = "1 hour", by: str = "event_type", value: str = "value") -> DataFrame:
    own = events.withWatermark(time_col, delay).groupBy(F.window(time_col, width), by)
    return own.agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))


def near_duplicate_stream(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", cfg: CleanConfig = CleanConfig()) -> DataFrame:
    """id, dropped: the greedy near-duplicate pass with the kept texts of each prefix as state."""
    keyed = docs.select(F.col(id_col).cast("long").alias("id"), t.duplicate_form(t.clean_text(F.col(text_col))).alias("form")).withColumn("prefix", F.substring("form", 1, cfg.near_dup_prefix))

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = list(state.get[0]) if state.exists else []
        for frame in frames:
            dropped = []
            for form in frame.sort_values("id")["form"]:
                like = any((m := SequenceMatcher(None, form, k)).quick_ratio() >= cfg.near_dup_ratio and m.ratio() >= cfg.near_dup_ratio for k in kept)
                dropped.append(like)
                if not like:
                    kept.append(form)
            yield pd.DataFrame({"id": frame.sort_values("id")["id"], "dropped": dropped})
        state.update((kept,))

    return keyed.groupBy("prefix").applyInPandasWithState(step, "id long, dropped boolean", "kept array<string>", "append", GroupStateTimeout.NoTimeout)
