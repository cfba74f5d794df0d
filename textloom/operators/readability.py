"""Readability by the published formulas.

Words are those of functions.text.words; sentences end at . ! ? and white space; syllables are groups of
vowels, less one for a silent e; a word is difficult if it isn't in the list of easy words and has two syllables
or more. The list can be given; the short default makes the Dale-Chall grade an approximation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as t

METRICS = ["flesch_kincaid", "flesch", "gunning_fog", "coleman_liau", "dale_chall", "ari", "linsear_write"]
#: A few easy words of two syllables and more.
EASY_WORDS = "about above after again against also always any another because before being between body city color common country cover different during early either every family father figure follow general given happy having however important into money morning mother never number only open order other over paper people perhaps picture power question second several simple study system table under until very water without woman".split()


def syllables(word: Column) -> Column:
    groups = F.regexp_count(word, F.lit("[aeiouy]+"))
    silent = (word.rlike("[^aeiouyl]e$") & (groups > 1)).cast("int")
    return F.greatest(F.lit(1), groups - silent)


_COUNTS = ("words", "sentences", "syllables", "letters", "long_words", "difficult")


def with_counts(df: DataFrame, text: Column, easy: list[str] = EASY_WORDS) -> DataFrame:
    """Adds __words, __sentences ...; words and their syllables are found once."""
    own, each = F.col("__own"), F.col("__each")
    out = df.withColumn("__own", t.words(text)).withColumn("__each", F.transform("__own", syllables))
    known = F.array(*map(F.lit, easy))
    hard = F.zip_with(own, each, lambda w, n: ((n >= 2) & ~F.array_contains(known, w)).cast("int"))
    total = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)
    made = {
        "words": F.size(own),
        "sentences": F.greatest(F.size(t.sentences(text)), F.lit(1)),
        "syllables": total(each),
        "letters": F.length(F.regexp_replace(F.lower(text), "[^a-z]", "")),
        "long_words": F.size(F.filter(each, lambda n: n >= 3)),
        "difficult": total(hard),
    }
    return out.withColumns({f"__{k}": v for k, v in made.items()}).drop("__own", "__each")


def formulas(n: dict[str, Column]) -> dict[str, Column]:
    """The grades from words W, sentences S, syllables, letters, long and difficult words; NULL without words."""
    w = F.when(n["words"] > 0, n["words"].cast("double"))
    s, x = n["sentences"].cast("double"), n["long_words"].cast("double")
    share = 100 * n["difficult"] / w
    r = ((w - x) + 3 * x) / s
    return {
        "flesch_kincaid": 0.39 * w / s + 11.8 * n["syllables"] / w - 15.59,
        "flesch": 206.835 - 1.015 * w / s - 84.6 * n["syllables"] / w,
        "gunning_fog": 0.4 * (w / s + 100 * x / w),
        "coleman_liau": 0.0588 * (100 * n["letters"] / w) - 0.296 * (100 * s / w) - 15.8,
        "dale_chall": 0.1579 * share + 0.0496 * w / s + F.when(share > 5, 3.6365).otherwise(0.0),
        "ari": 4.71 * n["letters"] / w + 0.5 * w / s - 21.43,
        "linsear_write": F.when(r > 20, r / 2).otherwise((r - 2) / 2),
        "smog": F.when(s >= 30, 1.043 * F.sqrt(30 * x / s) + 3.1291),
    }


def score_texts(df: DataFrame, text_col: str, prefix: str = "", min_chars: int = 20, easy: list[str] = EASY_WORDS) -> DataFrame:
    """Adds the seven grades and a status: missing, too_short or ok."""
    text = F.trim(F.col(text_col))
    status = F.when(text.isNull() | (text == ""), "missing").when(F.length(text) < min_chars, "too_short").otherwise("ok")
    staged = with_counts(df.withColumn("__status", status), F.coalesce(F.col(text_col), F.lit("")), easy)
    grades = formulas({k: F.col(f"__{k}") for k in _COUNTS})
    made = {f"{prefix}{m}_mean": F.when(F.col("__status") == "ok", grades[m]) for m in METRICS}
    out = staged.withColumns(made).withColumn(f"{prefix}readability_status", F.col("__status"))
    return out.drop("__status", *[f"__{k}" for k in _COUNTS])


def aggregate_chunks(chunks: DataFrame, id_cols: list[str], easy: list[str] = EASY_WORDS) -> DataFrame:
    """For each paper mean, std, p10 to p90 of each grade over its chunks; the std of one chunk is 0."""
    staged = with_counts(chunks, F.col("chunk_text"), easy)
    grades = formulas({k: F.col(f"__{k}") for k in _COUNTS})
    scored = staged.select(*id_cols, *[grades[m].alias(m) for m in METRICS])
    aggs = [F.count(F.lit(1)).alias("n_chunks")]
    for m in METRICS:
        c = F.col(m)
        aggs += [F.avg(c).alias(f"{m}_mean"), F.when(F.count(c) == 1, 0.0).otherwise(F.stddev_samp(c)).alias(f"{m}_std")]
        aggs += [F.percentile(c, F.lit(p / 100)).alias(f"{m}_p{p}") for p in (10, 25, 50, 75, 90)]
    return scored.groupBy(*id_cols).agg(*aggs)
