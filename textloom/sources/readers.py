"""Readers: CSV with missing tokens, texts, lists of files, paper JSON, PDF pages by an injected parser."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.papers import PAGES_SCHEMA
from ..operators.sampling import range_of

#: Texts that a CSV cell may hold for a missing value. Fixed values.
MISSING = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]


def missing_to_null(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    own = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    return df.withColumns({c: F.when(~F.col(f"`{c}`").isin(MISSING), F.col(f"`{c}`")) for c in (columns or own)})


def read_csv(spark: SparkSession, path: str, columns: list[str] | None = None, strings: list[str] | None = None, all_strings: bool = False) -> DataFrame:
    """A CSV with a header, quoted line breaks and missing tokens. Types are inferred but for `strings`; columns: only those."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    out = missing_to_null(raw.select(*[f"`{c}`" for c in columns]) if columns else raw)
    if all_strings:
        return out
    keep = set(strings or [])
    probe = [c for c in out.columns if c not in keep]
    numeric = out.agg(*[F.bool_and(F.col(f"`{c}`").try_cast("double").isNotNull() | F.col(f"`{c}`").isNull()).alias(c) for c in probe], *[F.bool_and(F.col(f"`{c}`").rlike(r"^-?\d{1,18}$")).alias(f"int {c}") for c in probe], *[F.count(f"`{c}`").alias(f"n {c}") for c in probe]).first() if probe else {}
    kinds = {c: "long" if numeric[f"int {c}"] else "double" for c in probe if numeric[c] and numeric[f"n {c}"]}
    return out.select(*[F.col(f"`{c}`").try_cast(kinds[c]).alias(c) if c in kinds else F.col(f"`{c}`") for c in out.columns])


def path_id(path: Column, suffixes: list[str] | None = None) -> Column:
    """The id in a file's name: the name without its known endings."""
    name = F.regexp_extract(path, r"([^/]+)$", 1)
    for ending in suffixes or [r"\.json\.sections\.txt", r"\.sections\.txt", r"\.txt", r"\.json\.sections", r"\.json"]:
        name = F.regexp_replace(name, ending + "$", "")
    return name


def read_texts(spark: SparkSession, path: str, pattern: str = "*.txt", splits: list[str] | None = None) -> DataFrame:
    """paper_id, split, path, text of files below a path (below each of its split folders); bytes that aren't UTF-8 are replaced. In no order: a sort would move all contents, `path` is there to sort by."""
    parts = []
    for s in splits or [None]:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(f"{path}/{s}" if s else path)
        parts.append(files.select(path_id(F.col("path")).alias("paper_id"), F.lit(s).cast("string").alias("split"), "path", _decode("content").alias("text")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@F.pandas_udf(T.StringType())
def _decode_slow(raw: pd.Series) -> pd.Series:
    return raw.map(lambda b: bytes(b).decode("utf-8", "replace"), na_action="ignore")


def _decode(col: str) -> Column:
    """UTF-8; only files that aren't valid travel to Python."""
    return F.when(F.is_valid_utf8(F.col(col).cast("string")), F.col(col).cast("string")).otherwise(_decode_slow(F.when(~F.is_valid_utf8(F.col(col).cast("string")), F.col(col))))


def read_list(spark: SparkSession, path: str, start: int = 0, end: int = -1) -> DataFrame:
    """The paths in a list file from start up to end, in its order; blank lines are left out."""
    whole = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("place", "path"))
    return range_of(whole.where(F.trim("path") != ""), ["place"], start, end).orderBy("place").select(F.trim("path").alias("path"))


def read_papers(spark: SparkSession, path: str, pattern: str = "*.json") -> DataFrame:
    """paper_id, path, pages of paper JSON files; keys that are missing are NULL."""
    out = spark.read.schema(PAGES_SCHEMA).option("multiLine", True).option("pathGlobFilter", pattern).json(path)
    return out.select(path_id(F.col("_metadata.file_path")).alias("paper_id"), F.col("_metadata.file_path").alias("path"), "pages")


def read_pdfs(spark: SparkSession, path: str, parser: Callable[[bytes], str]) -> DataFrame:
    """paper_id, pages_json, error of PDF files; parser turns a file's bytes into page JSON. A file that fails is a row with an error."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.pdf").load(path)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            made = []
            for raw in frame["content"]:
                try:
                    made.append((parser(bytes(raw)), None))
                except Exception as e:  # noqa: BLE001 a failed file is data
                    made.append((None, str(e)))
            yield pd.DataFrame({"path": frame["path"], "pages_json": [m[0] for m in made], "error": [m[1] for m in made]})

    out = files.select("path", "content").mapInPandas(run, "path string, pages_json string, error string")
    return out.select(F.regexp_replace(path_id(F.col("path")), r"\.pdf$", "").alias("paper_id"), "path", "pages_json", "error")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
