"""Spelling: words that a corpus doesn't know are put right by words that it does, found over common deletions and ranked by their neighbours.

A word is a run of letters (any script's, with inner apostrophes), lower-cased; it is known if it occurs `known` times or more. An unknown word of
MIN_LETTERS letters or more and a known one are candidates if they have a deletion in common (of one letter each, or none) and are
one insertion, deletion, substitution or swap of neighbours apart: both sides are indexed by their deletions, one row for each letter
of a distinct word, and meet by an equi-join, so no pair of words is tried that has none in common.

Each occurrence of an unknown word takes the candidate that stands most often between its neighbours, that is with the largest count of
(word before, candidate) and (candidate, word after) among all occurrences of the corpus, then the more frequent one, then the one that sorts first.
Without a neighbour in common the candidate's count has to be `sure` times the unknown word's. All counts are partial aggregations, all lookups joins on
words or pairs of words; a word in most rows is counted before it meets anything. Bitmaps of the unknown words that have candidates, then of the pairs that
their candidates would make, drop all other occurrences before these are shuffled, so only pairs that are looked up are counted.

Null and empty texts have no words. Corrections carry the place of their word (from 0, in words), so a word that a text repeats has one for each place; rows that repeat an id and
a text have theirs once, and count in all counts; rows of a null id are one text. An empty table has no corrections, and neither has one without known words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bitmaps import among
from ..sources.staging import discard, settle

KNOWN, SURE, MIN_LETTERS = 5, 20, 4
_LETTERS = r"([\p{L}\p{M}]+(?:['’][\p{L}\p{M}]+)*)"


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(_LETTERS), 1)


def deletions(word: Column) -> Column:
    """The word and all that is left of it without one letter."""
    n = F.length(word)
    return F.array_distinct(F.concat(F.array(word), F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, n)))))


def close(a: Column, b: Column) -> Column:
    """Whether two words are one insertion, deletion, substitution or swap of neighbouring letters apart."""
    letters = lambda w: F.array_sort(F.split(w, ""))
    far = F.levenshtein(a, b)
    at = F.array_position(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.coalesce(x != y, F.lit(True))), True).cast("int")
    swapped = F.substring(a, at, F.lit(1)) == F.substring(b, at + 1, F.lit(1))
    swapped = swapped & (F.substring(a, at + 1, F.lit(1)) == F.substring(b, at, F.lit(1))) & (F.substring(a, at + 2, F.length(a)) == F.substring(b, at + 2, F.length(b)))
    return (far == 1) | ((far == 2) & (F.length(a) == F.length(b)) & (letters(a) == letters(b)) & F.coalesce(swapped, F.lit(False)))


def candidates(counted: DataFrame, known: int = KNOWN, min_letters: int = MIN_LETTERS) -> DataFrame:
    """word, n, candidate, m of unknown words and known ones that are close; counted(word, n)."""
    indexed = lambda df, *names: df.select(*names, F.explode(deletions(F.col(names[0]))).alias("part"))
    rare = indexed(counted.where((F.col("n") < known) & (F.length("word") >= min_letters)), "word", "n")
    sure = indexed(counted.where(F.col("n") >= known).select(F.col("word").alias("candidate"), F.col("n").alias("m")), "candidate", "m")
    return rare.join(sure, "part").drop("part").distinct().where(close(F.col("word"), F.col("candidate")))


def corrections(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", known: int = KNOWN, sure: int = SURE, min_letters: int = MIN_LETTERS) -> DataFrame:
    """id, place, word, correction, context (how often it stands by the same neighbours in the corpus), m (its count)."""
    own = docs.select(F.col(id_col).alias("id"), words(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    at = lambda i: F.try_element_at("w", i)
    each = F.transform(F.sequence(F.lit(1), F.size("w")), lambda i: F.struct((i - 1).alias("place"), F.when(i > 1, at(i - 1)).alias("before"), at(i).alias("word"), at(i + 1).alias("after")))
    rows = own.select("id", F.explode(each).alias("x")).select("id", "x.*")
    counted = settle(own.select(F.explode("w").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")), "word-counts")
    near = settle(candidates(counted, known, min_letters), "candidates")
    unknown = near.select("word").distinct()
    tried = settle(among(rows, F.col("word"), unknown, unknown.count()).join(near, "word"), "unknown-words")
    pair = lambda a, b: F.struct(F.col(a).alias("a"), F.col(b).alias("b"))
    beside = tried.where("before is not null").select(pair("before", "candidate").alias("pair")).unionAll(tried.where("after is not null").select(pair("candidate", "after").alias("pair")))
    pairs = among(rows.where("after is not null").select(F.col("word").alias("a"), F.col("after").alias("b")), pair("a", "b"), beside, 2 * tried.count())
    pairs = settle(pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("k")), "word-pairs")
    before = pairs.select(F.col("a").alias("__a"), F.col("b").alias("__b"), F.col("k").alias("left_k"))
    after = pairs.select(F.col("a").alias("__c"), F.col("b").alias("__d"), F.col("k").alias("right_k"))
    context = F.coalesce("left_k", F.lit(0)) + F.coalesce("right_k", F.lit(0))
    known_by = tried.join(before, F.expr("before = __a and candidate = __b"), "left").join(after, F.expr("candidate = __c and after = __d"), "left")
    best = known_by.groupBy("id", "place", "word", "before", "after").agg(F.min(F.struct((-context).alias("context"), (-F.col("m")).alias("m"), "candidate", "n")).alias("best"))
    out = best.select(F.col("id").alias(id_col), "place", "word", F.col("best.candidate").alias("correction"), (-F.col("best.context")).alias("context"), (-F.col("best.m")).alias("m"), F.col("best.n").alias("n"))
    found = settle(out.where(f"context > 0 or m >= {sure} * n").drop("n"), "corrections")
    discard(counted, near, tried, pairs)
    return found


def scored(found: DataFrame, planted: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """planted, found, right, recall, precision of corrections against planted(id, place, right): one row."""
    truth = planted.select(F.col(id_col).alias("__id"), F.col("place").alias("__place"), "right")
    both = found.join(truth, (F.col(id_col) == F.col("__id")) & (F.col("place") == F.col("__place")), "full")
    hit = F.count_if(F.col("correction") == F.col("right"))
    row = both.agg(F.count("right").alias("planted"), F.count("correction").alias("found"), hit.alias("right"))
    share = lambda n: F.try_divide(F.col("right").cast("double"), F.col(n).cast("double"))
    return row.withColumns({"recall": share("planted"), "precision": share("found")})
