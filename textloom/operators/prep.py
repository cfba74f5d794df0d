"""Tabular preparation: renaming, coercion, imputation, rare categories, one-hot columns, scaling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as s
from .ordering import quantiles

CITATION_EDGES = [-0.1, 0, 4, 12, 30, float("inf")]
CITATION_LABELS = ["0", "1-4", "5-12", "13-30", "31+"]


def rename(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed({k: v for k, v in names.items() if k in df.columns})


def targets_last(df: DataFrame, targets: list[str]) -> DataFrame:
    own = s.existing(df, targets)
    return df.select(*[c for c in df.columns if c not in own], *own)


def move_after(df: DataFrame, col: str, anchor: str) -> DataFrame:
    rest = [c for c in df.columns if c != col]
    at = rest.index(anchor) + 1
    return df.select(*rest[:at], col, *rest[at:])


def coerce_numbers(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: s.to_number(F.col(c)) for c in s.existing(df, columns)})


def coerce_flags(df: DataFrame, columns: list[str]) -> DataFrame:
    own = {f.name: f.dataType.simpleString() for f in df.schema}
    return df.withColumns({c: s.to_flag(F.col(c).cast("int") if own[c] == "boolean" else F.col(c)) for c in s.existing(df, columns)})


def citation_bin(c: Column) -> Column:
    return s.cut(c, CITATION_EDGES, CITATION_LABELS)


def citation_ordinal(c: Column) -> Column:
    return s.cut(c, CITATION_EDGES, list(range(5)))


#: Parts into which the rows of a value are dealt before they meet what is known of it.
SALTS = 64


def fold_rare(df: DataFrame, col: str, least: int = 100, keep: list[str] | None = None, other: str = "Other", merge: tuple[str, str] | None = None) -> DataFrame:
    """Values with fewer than `least` rows become `other`, missing ones `Missing`; merge=(needle, name) first gathers values that contain the needle.

    Counts are aggregated and joined back over `SALTS` parts of each value's rows, so a value in most rows is never gathered in one task.
    """
    value = s.missing_as(F.col(col))
    if merge:
        value = F.when(F.lower(value).contains(merge[0]), F.lit(merge[1])).otherwise(value)
    own = df.withColumn(col, value)
    kept = own.groupBy(col).agg(F.count(F.lit(1)).alias("__n")).where((F.col("__n") >= least) | F.col(col).isin(keep or []))
    dealt = own.withColumn("__salt", F.pmod(F.xxhash64(*[f"`{c}`" for c in df.columns]), F.lit(SALTS)).cast("int"))
    known = kept.select(col, F.lit(True).alias("__k"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("__salt"))
    return dealt.join(known, [col, "__salt"], "left").withColumn(col, F.when(F.col("__k"), F.col(col)).otherwise(other)).drop("__k", "__salt").select(*df.columns)


def publication_flags(c: Column) -> dict[str, Column]:
    low = F.lower(F.coalesce(c, F.lit("")))
    has = lambda word: low.contains(word).cast("int")
    return {"is_journal_article": has("journalarticle"), "is_conference": has("conference"), "is_review": has("review"), "is_book": has("book")}


def medians(df: DataFrame, columns: list[str]) -> dict[str, float]:
    """Exact medians; columns without values are left out. One row for each column reaches the driver."""
    if not columns:
        return {}
    rows = df.select(*[s.finite(F.col(c)).alias(c) for c in columns]).unpivot([], columns, "feature", "value")
    got = {r["feature"]: r["q0"] for r in quantiles(rows, "value", [0.5], ["feature"]).collect()}
    return {c: got[c] for c in columns if c in got}


def impute(df: DataFrame, values: dict[str, float]) -> DataFrame:
    return df.withColumns({c: F.coalesce(s.finite(F.col(c)), F.lit(v)) for c, v in values.items()})


def impute_all(df: DataFrame, ids: list[str], named: list[str] | None = None, readability: list[str] | None = None) -> DataFrame:
    """A flag for missing readability, medians for named and then for all numeric columns, `Missing` for texts but ids."""
    if readability and s.existing(df, readability):
        some = [F.col(c).isNull() for c in s.existing(df, readability)]
        gone = some[0]
        for x in some[1:]:
            gone = gone | x
        df = df.withColumn("abstract_readability_missing", gone.cast("int"))
    numbers = [c for c in s.numeric_columns(df) if c not in ids and c != "abstract_readability_missing"]
    df = impute(df, medians(df, list(dict.fromkeys([*s.existing(df, named or []), *numbers]))))
    texts = [f.name for f in df.schema if f.dataType.simpleString() == "string" and f.name not in ids]
    return df.withColumns({c: s.missing_as(F.col(c)) for c in texts})


def derived_features(df: DataFrame, as_of_year: int) -> DataFrame:
    """Ratios, logarithms and age where their inputs exist."""
    col = F.col
    made = {
        "words_per_sentence": (["n_words", "n_sentences"], lambda: s.safe_ratio(col("n_words"), col("n_sentences"))),
        "chars_per_word": (["n_characters", "n_words"], lambda: s.safe_ratio(col("n_characters"), col("n_words"))),
        "log_perplexity": (["perplexity"], lambda: s.safe_log(col("perplexity"))),
        "abstract_log_perplexity": (["abstract_perplexity"], lambda: s.safe_log(col("abstract_perplexity"))),
        "paper_age": (["year"], lambda: F.lit(as_of_year) - col("year")),
    }
    return df.withColumns({k: make() for k, (needs, make) in made.items() if all(c in df.columns for c in needs)})


def one_hot(df: DataFrame, columns: list[str], drop_first: bool = True, max_levels: int = 1000) -> DataFrame:
    """0/1 columns col_value for the sorted levels of each column, without the first. Levels are schema, so they are bounded."""
    for c in columns:
        levels = [r[0] for r in df.select(c).where(F.col(c).isNotNull()).distinct().orderBy(c).limit(max_levels + 1).collect()]
        if len(levels) > max_levels:
            raise ValueError(f"{c} has more than {max_levels} levels: fold it first")
        df = df.withColumns({f"{c}_{v}": F.coalesce((F.col(c) == v).cast("int"), F.lit(0)) for v in levels[int(drop_first) :]}).drop(c)
    return df


def distinct_counts(df: DataFrame, columns: list[str]) -> dict[str, int]:
    """Distinct values of each column, exactly up to two, and 3 for more: extremes tell one from more, values between them two from more.

    Two aggregates without an expanded row for each column. NULL is no value.
    """
    if not columns:
        return {}
    row = df.agg(*[f(F.col(f"`{c}`")).alias(f"{k}{i}") for i, c in enumerate(columns) for k, f in (("low", F.min), ("high", F.max))]).first()
    wide = [i for i in range(len(columns)) if row[f"low{i}"] is not None and row[f"low{i}"] != row[f"high{i}"]]
    between = {}
    if wide:
        inner = lambda i: F.count_if((F.col(f"`{columns[i]}`") != F.lit(row[f"low{i}"])) & (F.col(f"`{columns[i]}`") != F.lit(row[f"high{i}"])))
        between = df.agg(*[inner(i).alias(f"n{i}") for i in wide]).first().asDict()
    return {c: 0 if row[f"low{i}"] is None else 1 if i not in wide else 3 if between[f"n{i}"] else 2 for i, c in enumerate(columns)}


def constant_columns(df: DataFrame, columns: list[str]) -> list[str]:
    return [c for c, n in distinct_counts(df, columns).items() if n <= 1]


def continuous_columns(df: DataFrame, columns: list[str]) -> list[str]:
    return [c for c, n in distinct_counts(df, columns).items() if n > 2]


def scaling(df: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and population standard deviation, 1 for a constant."""
    if not columns:
        return {}
    row = df.agg(*[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns]).first()
    return {c: (row[f"m_{c}"], row[f"s_{c}"] or 1.0) for c in columns}


def scale(df: DataFrame, fitted: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: (F.col(c) - F.lit(m)) / F.lit(d) for c, (m, d) in fitted.items() if m is not None})


def highly_correlated(df: DataFrame, columns: list[str], limit: float = 0.95) -> list[str]:
    """Columns that an earlier column, dropped or not, correlates with beyond the limit."""
    from .stats import _correlations

    gone = {j for _, j, _, _, _, r in _correlations(df, columns) if abs(r or 0.0) > limit}
    return [c for j, c in enumerate(columns) if j in gone]


def cap_classes(df: DataFrame, label: str, most: int, id_col: str, seed: int = 42) -> DataFrame:
    """At most `most` rows of each class, by md5 order; rows that repeat an id at the cut are in or out together. No class is put in order in one task."""
    from .sampling import _cuts, _place

    plan = df.groupBy(label).agg(F.least(F.count(F.lit(1)), F.lit(most)).alias("__most")).where(f"`{label}` is not null")
    cuts = _cuts(df.where(f"`{label}` is not null"), [label], id_col, seed, plan, ["__most"]).withColumnRenamed(label, "__class")
    known = df.join(cuts, F.col(label) == F.col("__class")).where(_place(id_col, seed) <= F.col("cut0")).select(*df.columns)
    gone = df.where(f"`{label}` is null")  # a group of its own
    return known if gone.isEmpty() else known.unionByName(gone.orderBy(_place(id_col, seed)).limit(most))


def drop_leaky(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.drop(*columns)


def unique_feature_names(names: list[str]) -> list[str]:
    """Names of letters, digits and _, with a number behind repeats."""
    import re

    seen: dict[str, int] = {}
    out = []
    for n in names:
        own = re.sub(r"[^0-9A-Za-z_]+", "_", n)
        seen[own] = seen.get(own, -1) + 1
        out.append(own if not seen[own] else f"{own}_{seen[own]}")
    return out
