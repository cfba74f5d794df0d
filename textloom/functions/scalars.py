"""Numeric and categorical scalar expressions. Missing is NULL throughout; NaN becomes NULL at the door."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def existing(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """Those of the columns that df has, in the order asked for."""
    own = set(df.columns)
    return [c for c in columns if c in own]


def find_column(df: DataFrame, candidates: Sequence[str]) -> str | None:
    """The first candidate that df has, whatever its case, in df's spelling."""
    own = {c.lower(): c for c in df.columns}
    return next((own[c.lower()] for c in candidates if c.lower() in own), None)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def with_prefix(df: DataFrame, prefix: str) -> list[str]:
    return [c for c in df.columns if c.startswith(prefix)]


def finite(c: Column) -> Column:
    """NULL for NaN and the infinities."""
    x = c.cast("double")
    return F.when(F.isnan(x) | x.isin(float("inf"), float("-inf")), None).otherwise(x)


def to_number(c: Column) -> Column:
    """Double, NULL where it isn't a number."""
    return finite(c.try_cast("double"))


def to_flag(c: Column) -> Column:
    """Integer part, 0 where it isn't a number."""
    return F.coalesce(c.try_cast("double").try_cast("int"), F.lit(0))


def missing_as(c: Column, value: str = "Missing") -> Column:
    return F.coalesce(c, F.lit(value))


def safe_ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), F.nullif(b.cast("double"), F.lit(0.0)))


def safe_log(c: Column) -> Column:
    return F.ln(F.when(c > 0, c))


def clip_upper(c: Column, cap: Column | float) -> Column:
    return F.when(c.isNotNull(), F.least(c, cap if isinstance(cap, Column) else F.lit(cap)))


def clamp(c: Column, low: float, high: float, default: float, whole: bool = False) -> Column:
    """A number held between two bounds; what isn't one becomes the default. whole: the part before the point."""
    x = c.try_cast("double")
    x = x.try_cast("int") if whole else x
    kind = "int" if whole else "double"
    return F.when(x.isNull(), F.lit(default)).otherwise(F.greatest(F.lit(low), F.least(F.lit(high), x))).cast(kind)


def cut(c: Column, edges: Sequence[float], labels: Sequence, include_lowest: bool = True) -> Column:
    """Right-closed bins between edges; NULL outside."""
    out = None
    for k, (a, b, label) in enumerate(zip(edges[:-1], edges[1:], labels)):
        above = (c >= a) if include_lowest and k == 0 else (c > a)
        below = F.lit(True) if b == float("inf") else (c <= b)
        out = F.when(above & below, F.lit(label)) if out is None else out.when(above & below, F.lit(label))
    return out


def exceeds(c: Column, threshold: float) -> Column:
    """1 or 0; a missing value doesn't exceed."""
    return F.coalesce((c > threshold).cast("int"), F.lit(0))


def mapped(c: Column, table: dict[str, str], otherwise: Column | None = None) -> Column:
    """A lookup on the trimmed lower-case text; what isn't there passes through trimmed."""
    key = F.lower(F.trim(c))
    pairs = [x for k, v in table.items() for x in (F.lit(k), F.lit(v))]
    return F.coalesce(F.element_at(F.create_map(*pairs), key), otherwise if otherwise is not None else F.trim(c))


def label_text(name: Column) -> Column:
    return F.initcap(F.replace(name, F.lit("_"), F.lit(" ")))
