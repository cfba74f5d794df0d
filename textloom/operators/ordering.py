"""Running sums, ranks and positions in a global order, without one task that sees all rows.

Rows are dealt to partitions by ranges of the order and written, so that the ranges stay what they are; each
partition sums its own rows, and the sums of the partitions before it, one row for each partition and key, are
joined back.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import settle


def _dealt(df: DataFrame, order: list[str]) -> DataFrame:
    return settle(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "dealt")


def with_running_sum(df: DataFrame, value: str, order: list[str], keys: list[str] | None = None, name: str = "before") -> DataFrame:
    """Adds the sum of `value` over the rows of the same keys that come before, in a total order."""
    return with_running_sums(df, {name: value}, order, keys)


def with_running_sums(df: DataFrame, sums: dict[str, str], order: list[str], keys: list[str] | None = None) -> DataFrame:
    """with_running_sum() of several columns, by the names of their sums."""
    keys = keys or []
    own = _dealt(df, [*keys, *order])
    parts = own.groupBy(*keys, "__part").agg(*[F.sum(v).alias(f"__sum{j}") for j, v in enumerate(sums.values())])
    before = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    earlier = [F.coalesce(F.sum(f"__sum{j}").over(before), F.lit(0)).alias(f"__before{j}") for j in range(len(sums))]
    offsets = parts.select(F.col("__part").alias("__part2"), *earlier, *[F.col(k).alias(f"__key{i}") for i, k in enumerate(keys)])
    inside = Window.partitionBy(*keys, "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    both = own.select("*", *[F.coalesce(F.sum(v).over(inside), F.lit(0)).alias(f"__within{j}") for j, v in enumerate(sums.values())])
    same: list[Column] = [F.col("__part") == F.col("__part2"), *(F.col(k).eqNullSafe(F.col(f"__key{i}")) for i, k in enumerate(keys))]
    joined = both.join(offsets, reduce(lambda a, b: a & b, same))
    return joined.select(*df.columns, *[(F.col(f"__before{j}") + F.col(f"__within{j}")).alias(name) for j, name in enumerate(sums)])


def quantiles(values: DataFrame, value: str, probs: list[float], keys: list[str] | None = None, names: list[str] | None = None) -> DataFrame:
    """keys, q0, q1 ... (or names): the exact quantiles of each group, with linear interpolation between neighbours.

    Equal values are counted first and placed by running sums over ranges of the values, so no task holds a whole
    feature; missing values don't count.
    """
    keys = keys or []
    counted = values.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__count"))
    ranked = with_running_sum(counted, "__count", [value], keys, "__below")
    ends = F.col("__below") + F.col("__count")
    sizes = ranked.groupBy(*[F.col(k).alias(f"__of{i}") for i, k in enumerate(keys)]).agg(F.max(ends).alias("__n"))
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"__of{i}")) for i, k in enumerate(keys)), F.lit(True))
    placed = ranked.join(F.broadcast(sizes), same) if not keys else ranked.join(sizes, same)
    found = []
    for i, p in enumerate(probs):
        at = (F.col("__n") - 1) * F.lit(float(p))
        here = lambda k: F.max(F.when((F.col("__below") <= k) & (k < ends), F.col(value).cast("double")))
        found += [here(F.floor(at)).alias(f"low{i}"), here(F.ceil(at)).alias(f"high{i}")]
    rows = placed.groupBy(*keys, "__n").agg(*found)
    share = lambda i, p: (F.col("__n") - 1) * F.lit(float(p)) - F.floor((F.col("__n") - 1) * F.lit(float(p)))
    mid = lambda i, p: F.when(F.col(f"low{i}") == F.col(f"high{i}"), F.col(f"low{i}")).otherwise(F.col(f"low{i}") * (1 - share(i, p)) + F.col(f"high{i}") * share(i, p))
    return rows.select(*keys, *[mid(i, p).alias(names[i] if names else f"q{i}") for i, p in enumerate(probs)])


def with_position(df: DataFrame, order: list[str], name: str = "position") -> DataFrame:
    """Adds the place of each row, from 0, in a total order."""
    return with_running_sum(df.withColumn("__one", F.lit(1).cast("long")), "__one", order, name=name).drop("__one")


def average_ranks(values: DataFrame, value: str, keys: list[str] | None = None, weight: str | None = None, name: str = "rank") -> DataFrame:
    """keys, value, `name`: the mean rank, from 1, of each distinct value. Equal values are counted before they are ranked."""
    keys = keys or []
    counted = values.groupBy(*keys, value).agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("__count"))
    ranked = with_running_sum(counted, "__count", [value], keys, "__below")
    return ranked.withColumn(name, F.col("__below") + (F.col("__count") + 1) / 2.0).drop("__count", "__below")
