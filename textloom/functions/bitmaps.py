"""A bitmap of hashed keys, broadcast to drop rows that meet none of them before they are shuffled to an exact join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A bitmap has 2**MAX_BITS bits (some 22 MB as rows of 1024 bits) at most, or EACH and more for each key if that is less.
MAX_BITS, EACH = 27, 16
_CELLS = 16


def _place(key: Column, bits: int) -> list[Column]:
    """bucket (of 1024 bits), cell (of 64 bits, within the bucket) and bit of a hashed key."""
    at = F.xxhash64(key).bitwiseAND((1 << bits) - 1)
    return [F.shiftright(at, 10).alias("__bucket"), F.shiftright(at, 6).bitwiseAND(_CELLS - 1).cast("int").alias("__cell"), at.bitwiseAND(63).cast("int").alias("__bit")]


def size(n: int) -> int:
    return min(MAX_BITS, max(10, (EACH * n - 1).bit_length()))


def among(rows: DataFrame, key: Column, keys: DataFrame, n: int) -> DataFrame:
    """The rows whose key is in the only column of keys (n rows, about), and a few others that hash like one; null keys go.

    The few are n in 2**size(n); beyond 2**MAX_BITS / EACH keys their share grows, so an exact join has to follow.
    """
    bits = size(n)
    placed = keys.where(F.col(keys.columns[0]).isNotNull()).select(*_place(F.col(keys.columns[0]), bits))
    cells = [F.coalesce(F.bit_or(F.when(F.col("__cell") == i, F.expr("shiftleft(1L, __bit)"))), F.lit(0).cast("long")) for i in range(_CELLS)]
    bitmap = placed.groupBy(F.col("__bucket").alias("__of")).agg(F.array(*cells).alias("__bits"))
    held = rows.where(key.isNotNull()).select("*", *_place(key, bits))
    hit = (F.col("__bucket") == F.col("__of")) & F.expr("shiftright(__bits[__cell], __bit) & 1L = 1L")
    return held.join(F.broadcast(bitmap), hit, "left_semi").drop("__bucket", "__cell", "__bit")
