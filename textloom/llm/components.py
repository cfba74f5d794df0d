"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, settle


def components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """node, component (its smallest reachable node) of every node of edges(a, b). Loops and repeats don't matter.

    Each step groups by node with partial minima and sends one row per edge, so a node with very many edges never
    has them collected; the joins are plain equi-joins that adaptive execution may split. Steps are written to
    the shared folder, and deleted from it when the next has been written. max_rounds guards against a fault only: rounds grow with the logarithm of the longest path.
    """
    low, high = F.least("a", "b"), F.greatest("a", "b")
    now = settle(edges.select(high.alias("a"), low.alias("b")).where("a <> b").distinct(), "edges")
    state = _state(now)
    for _ in range(max_rounds):
        if not state[0]:
            break
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = settle(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = settle(large.where("a <> b").distinct(), "large")
        lower = settle(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = large.join(lower, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(lower.select("a", F.col("m").alias("b")))
        done, now = (now, least, large, lower), settle(small.where("a <> b").distinct(), "small")
        discard(*done)
        before, state = state, _state(now)
        if before == state:
            break
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    found = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return found.unionByName(found.select(F.col("component").alias("node"), "component").distinct())


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first())
