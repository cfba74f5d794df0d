"""The catalogue of named queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a function of (spark, folder) and, if there is one, the same query in DuckDB's SQL."""

    def add(function: Callable) -> Callable:
        QUERIES[name] = function
        if sql is not None:
            ORACLE_SQL[name] = sql
        return function

    return add


def rounded(c: Column | str, digits: int = 6) -> Column:
    """Rounded as a double, so that the order of a sum doesn't show; 0 has no sign."""
    x = F.round(F.col(c) if isinstance(c, str) else c, digits)
    return F.when(x == 0, F.lit(0.0)).otherwise(x)


def round_all(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[rounded(f.name, digits).alias(f.name) if f.dataType.simpleString() == "double" else F.col(f.name).cast("long").alias(f.name) if f.dataType.simpleString() in ("int", "smallint") else F.col(f.name) for f in df.schema])


def r(expression: str, digits: int = 6) -> str:
    """The same in SQL."""
    return f"(round(({expression})::double, {digits}) + 0.0)"
