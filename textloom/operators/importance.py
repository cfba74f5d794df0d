"""Fusion of ranked feature lists from several sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .models import FEATURE_GROUPS

GROUP_ORDER = ["A. Temporal", "B. Text length / structural", "C. Publication / indexing metadata", "D. Reference count", "E. Research field", "F. Author impact", "G. Linguistic quality"]
# Words in the names of linguistic features.
READABILITY_WORDS = ["flesch", "gunning", "coleman", "dale", "ari", "linsear"]
LINGUISTIC_WORDS = [*READABILITY_WORDS, "perplexity", "grammar", "native", "verdict", "readability"]


def ranked_lists(spark: SparkSession, sources: dict[str, list[str]]) -> DataFrame:
    """source, feature, rank from 1, rank_score = n - rank + 1."""
    rows = [(s, f.replace(" ", "_"), i, len(fs) - i + 1) for s, fs in sources.items() for i, f in enumerate(fs, 1)]
    return spark.createDataFrame(rows, "source string, feature string, rank int, rank_score int")


def ranked_scores(scores: DataFrame, most: int) -> DataFrame:
    """source, feature, rank, rank_score of the `most` features of each source with the highest importance; equal ones by name."""
    from pyspark.sql import Window

    of = Window.partitionBy("source")
    placed = scores.withColumn("rank", F.row_number().over(of.orderBy(F.desc("importance"), "feature"))).where(F.col("rank") <= most)
    return placed.select("source", "feature", "rank", (F.max("rank").over(of) - F.col("rank") + 1).alias("rank_score"))


def _has(c: Column, words: list[str]) -> Column:
    return c.rlike("|".join(words))


def main_group(c: Column) -> Column:
    member = lambda g: c.isin(FEATURE_GROUPS[g])
    a, b, p, r, e, i, g = GROUP_ORDER
    return (
        F.when(member("temporal"), a)
        .when(member("text_structure"), b)
        .when(c.startswith("publication_source_") | member("publication_metadata"), p)
        .when(member("reference_count"), r)
        .when(c.startswith("primary_category_"), e)
        .when(member("author_impact"), i)
        .when(_has(c, LINGUISTIC_WORDS), g)
        .otherwise("Other")
    )


def linguistic_group(c: Column) -> Column:
    return (
        F.when(c.isin(FEATURE_GROUPS["grammar"]), "Grammatical accuracy")
        .when(c.isin(FEATURE_GROUPS["nativeness"]), "Native-like language use")
        .when(c.contains("abstract_perplexity"), "Perplexity")
        .when(c.startswith("abstract_") & _has(c, [*READABILITY_WORDS, "readability"]), "Abstract readability")
        .when(_has(c, READABILITY_WORDS), "Paper readability")
    )


def with_groups(lists: DataFrame) -> DataFrame:
    return lists.withColumns({"main_group": main_group(F.col("feature")), "linguistic_group": linguistic_group(F.col("feature"))})


def feature_summary(lists: DataFrame) -> DataFrame:
    """Frequency, total score, mean and best rank of each feature, most frequent first."""
    out = lists.groupBy("feature").agg(F.count_distinct("source").alias("frequency"), F.sum("rank_score").alias("total_rank_score"), F.avg("rank").alias("mean_rank"), F.min("rank").alias("best_rank"), F.min("main_group").alias("feature_group"))
    return out.orderBy(F.desc("frequency"), F.desc("total_rank_score"), "best_rank", "feature")


def group_summary(lists: DataFrame, by: str = "main_group") -> DataFrame:
    own = lists.where(F.col(by).isNotNull())
    return own.groupBy(by).agg(F.count("feature").alias("total_mentions"), F.count_distinct("feature").alias("unique_features"), F.sum("rank_score").alias("total_rank_score"), F.avg("rank_score").alias("mean_rank_score"), F.max("rank_score").alias("max_rank_score")).orderBy(F.desc("max_rank_score"), by)


def top_in_groups(summary: DataFrame, k: int = 10) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("feature_group").orderBy(F.desc("frequency"), F.desc("total_rank_score"), "best_rank", "feature")
    return summary.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def linguistic_features(summary: DataFrame) -> DataFrame:
    return summary.where(F.col("feature_group") == GROUP_ORDER[-1])


def max_pivot(lists: DataFrame, sources: list[str], by: str = "main_group", order: list[str] | None = None) -> DataFrame:
    """The best score of each group in each source, 0 where it has none, in the order of the groups, with the mean over the sources."""
    order = order or GROUP_ORDER
    spark = lists.sparkSession
    best = lists.groupBy(by).pivot("source", sources).agg(F.max("rank_score"))
    names = spark.createDataFrame(list(enumerate(order)), f"ordinal int, `{by}` string")
    out = names.join(best, by, "left").fillna(0, sources)
    mean = sum((F.col(f"`{s}`") for s in sources[1:]), F.col(f"`{sources[0]}`")) / len(sources)
    return out.withColumn("mean_of_max", mean).orderBy("ordinal")


def with_scores(features: DataFrame, scores: DataFrame, key: str = "feature", value: str = "importance", default: float = 0.0) -> DataFrame:
    """Looks each feature's score up; features without one get the default."""
    side = scores.select(F.col(key).alias("__key"), F.col(value).alias(value))
    return features.join(side, F.col(key) == F.col("__key"), "left").drop("__key").withColumn(value, F.coalesce(F.col(value).cast("double"), F.lit(default)))
