"""Quantile bins, proportional allocation, stratified samples and splits.

Random choices are an order by md5(id || seed): the same rows for the same seed, whatever the partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as s
from .ordering import quantiles, with_position, with_running_sum

# Research fields of the pool.
FIELDS = ["Physics", "Computer Science", "Mathematics", "Engineering", "Materials Science", "Medicine", "Environmental Science", "Chemistry", "Economics", "Biology"]


def iqr_cap(df: DataFrame, col: str, factor: float = 3.0) -> float:
    """max(Q3 + factor * IQR, p95) of the positive values; Q3 if the IQR is 0."""
    found = quantiles(df.select(col).where(F.col(col) > 0), col, [0.25, 0.75, 0.95]).first()
    if found is None:
        raise ValueError(f"{col} has no positive values")
    q1, q3, p95 = found
    return float(q3) if q3 == q1 else float(max(q3 + factor * (q3 - q1), p95))


def quantile_edges(df: DataFrame, col: str, n: int) -> list[float]:
    """Distinct rounded quantiles at 0, 1/n ... 1; round half to even."""
    found = quantiles(df.select(col), col, [i / n for i in range(n + 1)])
    got = found.select(*[F.bround(c).alias(c) for c in found.columns]).first()
    return sorted(set(got)) if got else []


def plain_bins(df: DataFrame, col: str, n: int) -> Column:
    """Labels left-right of right-closed quantile bins."""
    edges = quantile_edges(df, col, n)
    labels = [f"{a:.0f}-{b:.0f}" for a, b in zip(edges[:-1], edges[1:])]
    return s.cut(F.col(col), edges, labels) if labels else F.lit(None).cast("string")


def zero_bins(df: DataFrame, col: str, points: int) -> Column:
    """Labels 0, a-b ..., last a+: zero alone, then quantile bins of the positive values."""
    found = quantiles(df.select(col).where(F.col(col) > 0), col, [i / (points - 1) for i in range(points)])
    got = found.select(*[F.bround(c).alias(c) for c in found.columns]).first()
    edges = [-0.1, 0.0, *sorted(set(got or []))[1:]]
    labels = ["0"]
    for k in range(1, len(edges) - 1):
        low = f"{edges[k] + 1:.0f}"
        labels.append(f"{low}+" if k == len(edges) - 2 else f"{low}-{edges[k + 1]:.0f}")
    return s.cut(F.col(col), edges, labels)


def stratum(*cols: Column) -> Column:
    return F.concat_ws(" || ", *cols)


def allocate(counts: DataFrame, total: int, by: list[str] | None = None, stratum_col: str = "stratum", capacity: str = "capacity") -> DataFrame:
    """Adds `allocated`: the total in proportion to the capacities, exactly, never above them.

    The base is the floor of the share; what is left goes, one each, to the strata with the largest remainder of
    their share of the remaining capacity, ties to the stratum that sorts first. A total beyond the capacity is
    an error.
    """
    w = Window.partitionBy(*(by or [F.lit(0)]))
    cap = F.col(capacity).cast("double")
    out = counts.withColumn("__all", F.sum(cap).over(w))
    out = out.withColumn("__base", F.when(F.col("__all") < total, F.raise_error(F.concat(F.lit("asked for more than "), F.col("__all").cast("string")))).otherwise(F.floor(cap / F.col("__all") * total)).cast("long"))
    out = out.withColumn("__left", F.lit(total) - F.sum("__base").over(w)).withColumn("__rest", F.col(capacity) - F.col("__base"))
    raw = F.try_divide(F.col("__rest").cast("double"), F.sum(F.col("__rest").cast("double")).over(w)) * F.col("__left")
    out = out.withColumn("__frac", F.coalesce(raw - F.floor(raw), F.lit(0.0)))
    place = F.row_number().over(w.orderBy((F.col("__rest") <= 0).cast("int"), F.col("__frac").desc(), stratum_col))
    out = out.withColumn("allocated", F.col("__base") + (place <= F.col("__left")).cast("long"))
    return out.drop("__all", "__base", "__left", "__rest", "__frac")


def seeded(id_col: str, seed: int) -> Column:
    return F.md5(F.concat(F.col(id_col).cast("string"), F.lit(str(seed))))


def _cuts(df: DataFrame, keys: list[str], id_col: str, seed: int, plan: DataFrame, counts: list[str]) -> DataFrame:
    """keys, cut0, cut1 ...: the place in the random order, (hash, id), at which each group has had so many rows as plan's columns say, NULL for none.

    Only keys, hashes and ids are put in order, by ranges, so a group in most rows is never one task's; the rows
    themselves stay where they are.
    """
    own = df.select(*keys, seeded(id_col, seed).alias("__h"), F.col(id_col).alias("__id"), F.lit(1).cast("long").alias("__one"))
    placed = with_running_sum(own, "__one", ["__h", "__id"], keys, "__before").join(plan, keys)
    at = [F.max(F.when(F.col("__before") + 1 == F.col(c), F.struct("__h", "__id"))).alias(f"cut{i}") for i, c in enumerate(counts)]
    hit = " or ".join(f"__before + 1 = {c}" for c in counts)
    return placed.where(hit).groupBy(*keys).agg(*at)


def _place(id_col: str, seed: int) -> Column:
    return F.struct(seeded(id_col, seed).alias("__h"), F.col(id_col).alias("__id"))


def stratified_sample(df: DataFrame, stratum_cols: list[str], total: int, id_col: str, seed: int = 42, by: list[str] | None = None) -> DataFrame:
    """Exactly `total` rows (for each value of `by`), allocated to the strata in proportion. Rows that repeat an id are in or out together."""
    keys = [*(by or []), "stratum"]
    keyed = df.withColumn("stratum", stratum(*[F.col(c).cast("string") for c in stratum_cols]))
    counts = keyed.groupBy(*keys).agg(F.count(F.lit(1)).alias("capacity"))
    plan = allocate(counts, total, by or []).select(*keys, "allocated")
    cuts = _cuts(keyed, keys, id_col, seed, plan, ["allocated"])
    return keyed.join(cuts, keys).where(_place(id_col, seed) <= F.col("cut0")).select(*[F.col(f"`{c}`") for c in keys], *[F.col(f"`{c}`") for c in df.columns if c not in keys])


def balanced_sample(df: DataFrame, class_col: str, per_class: int, stratum_cols: list[str], id_col: str, seed: int = 42) -> DataFrame:
    """per_class rows of each class in {0, 1}, stratified within it."""
    pool = df.where(F.col(class_col).isin(0, 1))
    return stratified_sample(pool, stratum_cols, per_class, id_col, seed, [class_col])


def split(df: DataFrame, stratum_col: str, id_col: str, seed: int = 42, test: float = 0.2, val: float = 0.25) -> DataFrame:
    """Adds `split`: ceil(test * n) test rows, ceil(val * rest) of the others for validation, stratified by largest remainders.

    Rows that repeat an id stay together.
    """
    keyed = df.withColumn("stratum", F.coalesce(F.col(stratum_col).cast("string"), F.lit("")))
    counts = keyed.groupBy("stratum").agg(F.count(F.lit(1)).alias("capacity"))
    n = df.count()
    n_test = -(-n * round(test * 1000) // 1000)
    n_val = -(-(n - n_test) * round(val * 1000) // 1000)
    plan = allocate(counts, n_test).withColumnRenamed("allocated", "n_test").withColumn("capacity", F.col("capacity") - F.col("n_test"))
    plan = allocate(plan, n_val).select("stratum", "n_test", (F.col("n_test") + F.col("allocated")).alias("n_both"))
    cuts = _cuts(keyed, ["stratum"], id_col, seed, plan, ["n_test", "n_both"]).withColumnRenamed("stratum", "__s")
    own = F.coalesce(F.col(stratum_col).cast("string"), F.lit(""))
    here = _place(id_col, seed)
    part = F.when(here <= F.col("cut0"), "test").when(here <= F.col("cut1"), "val").otherwise("train")
    return df.join(cuts, own == F.col("__s"), "left").withColumn("split", part).drop("__s", "cut0", "cut1")


def shard(df: DataFrame, order: list[str], shards: int, contiguous: bool = True) -> DataFrame:
    """Adds `shard`: contiguous blocks of ceil(n / shards) rows, or every shards-th row, in a stated order."""
    placed = with_position(df, order, "__place")
    size = max(1, -(-df.count() // shards)) if contiguous else shards
    place = F.col("__place")
    return placed.withColumn("shard", (F.floor(place / size) if contiguous else F.pmod(place, F.lit(size))).cast("int")).drop("__place")


def range_of(df: DataFrame, order: list[str], start: int = 0, end: int = -1) -> DataFrame:
    """The rows from start up to end in a stated order; a negative end takes all the rest."""
    placed = with_position(df, order, "__n")
    kept = placed.where(F.col("__n") >= start)
    return (kept.where(F.col("__n") < end) if end >= 0 else kept).drop("__n")


def citation_pool(df: DataFrame, fields: dict[str, str] | None = None) -> DataFrame:
    """The rows of a metadata pool that may be sampled, with their derived columns; columns are found by candidate names."""
    find = lambda *names: s.find_column(df, names)
    year, cites, field, doi = find("year"), find("citationcount", "citation_count", "citations", "citation"), find("category1", "field"), find("has_doi", "doi", "doi_present", "hasdoi")
    missing = [n for n, c in (("year", year), ("citations", cites), ("category1", field), ("doi", doi)) if c is None]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    table = {f.lower(): f for f in FIELDS} | (fields or {})
    out = df.withColumns({"year": s.to_number(F.col(year)), "citation_count": s.to_number(F.col(cites)), "field": s.mapped(F.col(field), table), "doi": s.to_number(F.col(doi))})
    return out.where(F.col("doi").isin(0, 1) & F.col("year").between(2005, 2021) & F.col("citation_count").isNotNull() & F.col("field").isin(FIELDS))
