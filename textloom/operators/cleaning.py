"""Cleaning with audited reasons, exact and greedy near-duplicate removal, label joins."""

from __future__ import annotations

from bisect import bisect_left
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..sources.staging import discard, settle

EXACT, NEAR = "exact_duplicate_abstract", "near_duplicate_abstract"


@dataclass(frozen=True)
class CleanConfig:
    min_chars: int = 100
    min_words: int = 20
    min_alpha_chars: int = 30
    min_alpha_ratio: float = 0.50
    max_punct_ratio: float = 0.30
    max_chars: int = 5000
    max_words: int = 3000
    min_lexical_diversity: float = 0.20
    max_symbol_ratio: float = 0.15
    max_markup: int = 3
    max_single_letters: int = 30
    near_dup_ratio: float = 0.95
    near_dup_prefix: int = 120


def removal_reason(text: Column, cfg: CleanConfig = CleanConfig(), stats: dict[str, Column] | None = None, words: Column | None = None) -> Column:
    """The first of sixteen rules that a clean text breaks; the empty text if none. stats, words: columns that have them already."""
    s = stats or t.text_stats(text)
    low = F.trim(F.lower(text))
    markup = F.length(low) - F.length(F.translate(low, "<>", ""))
    rules = [
        (low.isin(t.PLACEHOLDERS), "placeholder_abstract"),
        (s["clean_length"] < cfg.min_chars, "too_short_chars"),
        (s["word_count"] < cfg.min_words, "too_few_words"),
        (s["alpha_chars"] < cfg.min_alpha_chars, "too_few_alphabetic_chars"),
        (s["alpha_ratio"] <= cfg.min_alpha_ratio, "low_alphabetic_ratio"),
        (s["punct_ratio"] >= cfg.max_punct_ratio, "high_punctuation_ratio"),
        (s["clean_length"] > cfg.max_chars, "too_long_chars_possible_full_text"),
        (s["word_count"] > cfg.max_words, "too_long_words_possible_full_text"),
        (s["lexical_diversity"] < cfg.min_lexical_diversity, "low_lexical_diversity"),
        (s["symbol_ratio"] > cfg.max_symbol_ratio, "formula_or_symbol_heavy"),
        (s["period_count"] == 0, "no_period"),
        (~t.has_verb_like_word(text, words), "no_verb_like_word"),
        (t.matches_any(low, t.BOILERPLATE_PATTERNS), "publisher_boilerplate"),
        (t.matches_any(low, t.REFERENCE_PATTERNS), "reference_like_content"),
        (markup >= cfg.max_markup, "remaining_markup_corruption"),
        (t.single_letters(text) > cfg.max_single_letters, "many_single_letter_formula_fragments"),
    ]
    out = F.when(*rules[0])
    for condition, reason in rules[1:]:
        out = out.when(condition, reason)
    return out.otherwise("")


def classify(df: DataFrame, text_col: str = "text", cfg: CleanConfig = CleanConfig(), unescape: bool = True) -> DataFrame:
    """Adds clean_text, its statistics and removal_reason."""
    out = df.withColumn("clean_text", t.clean_text(F.col(text_col), unescape))
    out = out.withColumn("__words", t.words(F.col("clean_text")))  # found once, used by four rules
    made = t.text_stats(F.col("clean_text"), F.col("__words"))
    out = out.withColumns(made)
    reason = removal_reason(F.col("clean_text"), cfg, {k: F.col(k) for k in made}, F.col("__words"))
    return out.withColumn("removal_reason", reason).drop("__words")


def passed(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", cfg: CleanConfig = CleanConfig()) -> DataFrame:
    """id_col and clean_text of the rows that break no rule. The classified rows are written first: a filter on the reason would be pushed below the chain of cleaning expressions and repeat it for each use."""
    rows = classify(df, text_col, cfg).select(id_col, "clean_text", "removal_reason")
    return settle(rows, "classified").where("removal_reason = ''").drop("removal_reason")


def exact_duplicates(df: DataFrame, text_col: str = "clean_text", id_col: str = "doc_id") -> DataFrame:
    """Ids of texts whose normal form a row with a smaller id has. Forms are counted before they meet; a form in most rows is never gathered."""
    own = settle(df.select(id_col, F.md5(t.duplicate_form(F.col(text_col))).alias("form")), "forms")
    firsts = own.groupBy("form").agg(F.min(id_col).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return own.join(firsts, "form").where(F.col(id_col) != F.col("first")).select(id_col)


#: Texts of one prefix that are decided in order by one task at a time, and texts that one task then holds against those it kept.
BATCH, SLICE = 300, 100


def _places(text: str) -> dict[str, list[int]]:
    """Where each character stands."""
    out: dict[str, list[int]] = {}
    for i, c in enumerate(text):
        out.setdefault(c, []).append(i)
    return out


#: Characters that are compared at a time.
STRIDE = 64


class _Known:
    """A text that others are held against by the ratio of difflib's SequenceMatcher.

    Matches start at characters that aren't popular (in texts of 200 and more, those in at most 1 % of the places and one more) and are
    extended by all; only such places are looked at, where SequenceMatcher walks through each window. It stops where what can still match isn't enough.
    """

    def __init__(self, text: str, places: dict[str, list[int]]):
        few = len(text) // 100 + 1
        self.text, self.starts = text, places if len(text) < 200 else {c: at for c, at in places.items() if len(at) <= few}

    def like(self, text: str, places: dict[str, list[int]], limit: float) -> bool:
        """Whether SequenceMatcher(None, text, self.text).ratio() reaches the limit."""
        total, most = len(text) + len(self.text), min(len(text), len(self.text))
        if not total:
            return limit <= 1.0
        starts = sorted(i for c in self.starts.keys() & places.keys() for i in places[c])
        queue = [(0, len(text), 0, len(self.text))]
        while queue:
            if 2.0 * most / total < limit:
                return False
            low, high, own_low, own_high = queue.pop()
            i, j, n = self._longest(text, starts, low, high, own_low, own_high)
            most -= min(high - low, own_high - own_low) - n
            if n:
                for part in ((low, i, own_low, j), (i + n, high, j + n, own_high)):
                    if part[0] < part[1] and part[2] < part[3]:
                        queue.append(part)
                        most += min(part[1] - part[0], part[3] - part[2])
        return 2.0 * most / total >= limit

    def _longest(self, text: str, starts: list[int], low: int, high: int, own_low: int, own_high: int) -> tuple[int, int, int]:
        """SequenceMatcher.find_longest_match(): (place, own place, length) of the first longest match in a window."""
        i, j, n = low, own_low, 0
        runs: dict[int, int] = {}
        last, end = -2, bisect_left(starts, high)
        for place in range(bisect_left(starts, low), end):
            at = starts[place]
            before, runs = runs if at == last + 1 else {}, {}
            last = at
            own = self.starts[text[at]]
            first = bisect_left(own, own_low)
            if not before and (place + 1 == end or starts[place + 1] != at + 1):  # a match of one character, with none beside it
                if not n and first < len(own) and own[first] < own_high:
                    i, j, n = at, own[first], 1
                continue
            for k in range(first, bisect_left(own, own_high)):
                run = runs[own[k]] = before.get(own[k] - 1, 0) + 1
                if run > n:
                    i, j, n = at - run + 1, own[k] - run + 1, run
        for step in (STRIDE, 1):
            while i - step >= low and j - step >= own_low and text[i - step : i] == self.text[j - step : j]:
                i, j, n = i - step, j - step, n + step
        for step in (STRIDE, 1):
            while i + n + step <= high and j + n + step <= own_high and text[i + n : i + n + step] == self.text[j + n : j + n + step]:
                n += step
        return i, j, n


def near_duplicates(df: DataFrame, text_col: str = "clean_text", id_col: str = "doc_id", cfg: CleanConfig = CleanConfig(), batch: int = BATCH) -> DataFrame:
    """Ids that a greedy pass in id order drops: the normal form is at least near_dup_ratio like one kept before it with the same prefix.

    The pass goes by rounds. In each, the first `batch` undecided texts of every prefix are decided in order among
    themselves, and then all the others of that prefix are held against those kept, SLICE to a task. So a prefix
    that very many texts share costs a round for each batch of texts kept, and no task sees more than a batch and a
    slice; texts alone with their prefix never reach Python. Prefixes are dealt to a fixed number of tasks, as few
    bytes of text take long and adaptive execution would put them all into one.
    """
    own = df.select(F.col(id_col).cast("long").alias("id"), t.duplicate_form(F.col(text_col)).alias("form"))
    own = settle(own.withColumn("prefix", F.substring("form", 1, cfg.near_dup_prefix)), "prefixes")
    shared = own.groupBy("prefix").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    limit = cfg.near_dup_ratio
    verdicts = "id long, form string, prefix string, kept boolean"

    def decide(group: pd.DataFrame) -> pd.DataFrame:
        kept: list[_Known] = []
        flags = []
        group = group.sort_values("id")
        for form in group["form"]:
            places = _places(form)
            flags.append(not any(k.like(form, places, limit) for k in kept))
            if flags[-1]:
                kept.append(_Known(form, places))
        return group[["id", "form", "prefix"]].assign(kept=pd.Series(flags, index=group.index, dtype="bool"))

    def hold_against(rows: pd.DataFrame, kept: pd.DataFrame) -> pd.DataFrame:
        known = [_Known(form, _places(form)) for form in kept.sort_values("id")["form"]]
        flags = []
        for form in rows["form"]:
            places = _places(form)
            flags.append(not any(k.like(form, places, limit) for k in known))
        return rows[["id", "form", "prefix"]].assign(kept=pd.Series(flags, index=rows.index, dtype="bool"))

    crowd = own.join(shared.select("prefix"), "prefix", "left_semi").select("id", "form", "prefix")
    tasks = max(int(own.sparkSession.conf.get("spark.sql.shuffle.partitions")), own.sparkSession.sparkContext.defaultParallelism)
    place = F.rank().over(Window.partitionBy("prefix").orderBy("id"))  # rows of one id stay together
    lost, before = [], own  # narrow tables of dropped ids; what the round before left, which goes when it has been read
    while True:
        heads = settle(crowd.repartition(tasks, "prefix").withColumn("place", place).where(F.col("place") <= batch).groupBy("prefix").applyInPandas(decide, verdicts), "decided")
        last = heads.groupBy("prefix").agg(F.max("id").alias("last"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= batch).drop("n")
        rest = settle(crowd.join(last, "prefix").where(F.col("id") > F.col("last")).drop("last"), "undecided")
        discard(before)
        done = heads.where("not kept").select("id")
        if rest.isEmpty():
            lost.append(settle(done, "dropped"))
            discard(heads, rest)
            break
        parts = settle(rest.groupBy("prefix").agg(F.ceil(F.count(F.lit(1)) / SLICE).cast("int").alias("parts")), "parts")
        salted = rest.join(parts, "prefix").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).drop("parts")
        forms = heads.where("kept").join(parts, "prefix").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts", "kept")
        judged = salted.repartition(tasks, "prefix", "part").groupBy("prefix", "part").cogroup(forms.repartition(tasks, "prefix", "part").groupBy("prefix", "part")).applyInPandas(hold_against, verdicts)
        judged = settle(judged, "held")
        lost.append(settle(done.unionByName(judged.where("not kept").select("id")), "dropped"))
        discard(heads, rest, parts)
        crowd, before = judged.where("kept").drop("kept"), judged
        if crowd.isEmpty():
            discard(before)
            break
    return reduce(DataFrame.unionByName, lost).withColumnRenamed("id", id_col)


def clean(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", cfg: CleanConfig = CleanConfig()) -> tuple[DataFrame, DataFrame]:
    """(kept, removed): kept rows have the clean text, its length and md5; removed rows their statistics and reason.

    The classified rows are staged: every later step reads them.
    """
    rows = settle(classify(df, text_col, cfg), "classified")
    passed = rows.where("removal_reason = ''")
    exact = exact_duplicates(passed, id_col=id_col).withColumn("dup_reason", F.lit(EXACT))
    unique = passed.join(exact, id_col, "left_anti")
    near = near_duplicates(unique, id_col=id_col, cfg=cfg).withColumn("dup_reason", F.lit(NEAR))
    dups = settle(exact.unionByName(near), "duplicates")
    kept = passed.join(dups.select(id_col), id_col, "left_anti")
    text = F.col("clean_text")
    kept = kept.select(*[text.alias(c) if c == text_col else F.col(c) for c in df.columns], F.length(text).alias("abstract_length"), F.md5(text).alias("abstract_md5_hash"))
    lost = passed.join(dups, id_col).withColumn("removal_reason", F.col("dup_reason")).drop("dup_reason")
    return kept, rows.where("removal_reason <> ''").unionByName(lost.select(*rows.columns))


def drop_duplicate_keys(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key in a stated order, by an aggregate with partial results."""
    first = F.min_by(F.struct(*df.columns), F.struct(*order)).alias("row")
    return df.groupBy(F.col(key).alias("__key")).agg(first).select("row.*")


def left_join_first(left: DataFrame, right: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Left join with the first right row of each key; of shared columns the right one wins."""
    side = drop_duplicate_keys(right, key, order)
    return left.drop(*[c for c in side.columns if c != key]).join(side, key, "left")


def duplicate_columns(df: DataFrame, columns: list[str], id_col: str) -> list[tuple[str, str]]:
    """(column, earlier column) for columns equal in every row: one pass of hashes, one to confirm."""
    digest = lambda c: F.bit_xor(F.xxhash64(F.col(id_col), F.col(c).cast("double")))
    sums = df.agg(*[digest(c).alias(c) for c in columns]).first().asDict()
    pairs, seen = [], {}
    for c in columns:
        if sums[c] in seen:
            pairs.append((c, seen[sums[c]]))
        else:
            seen[sums[c]] = c
    if not pairs:
        return []
    equal = df.agg(*[F.bool_and(F.col(a).cast("double").eqNullSafe(F.col(b).cast("double"))).alias(f"{i}") for i, (a, b) in enumerate(pairs)]).first()
    return [p for p, same in zip(pairs, equal) if same]
