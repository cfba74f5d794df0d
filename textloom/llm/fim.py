"""Fill-in-the-middle: a text becomes prefix, suffix and middle behind sentinels, cut at the ends of lines.

A Split pre-tokenizer of the tokenizers library, with isolated matches of UNITS and without any training, gives the
code-point offsets of a text's units. Their number is n; two hashed numbers of 0 to n, ranked, are the places at which the
prefix and the middle end, and slices between those offsets are the three parts. Nothing is random: all choices come from
the hex SHA-256 of `seed:` and the decimal doc_id, whose first four groups of 8 digits are h1 to h4.

A text stays plain if it is empty, holds a sentinel, or h3 % 100 >= rate; else it is spm (suffix, prefix, middle) if h4 % 100 < spm_rate
and psm (prefix, suffix, middle) if not. `restore` gives the text back from output and form alone: no sentinel can
begin inside another, so none comes about where parts meet.

A null text counts as empty and its output is empty; a null doc_id is hashed as no digits. Rows that repeat give equal
outputs. An empty table gives an empty one. Other columns stay; of clashing names the operator's wins. A text of any
length is worked on in whole, cut at line ends into stretches of about STRETCH code points for the library, whose copies take
many times the text; one longer line is one unit and one stretch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import release

UNITS = r"[^\n]*\n|[^\n]+"
STRETCH = 1 << 18
SENTINELS = ("<P>", "<S>", "<M>")
MADE = ("output", "form", "n", "prefix_chars", "middle_chars")


@dataclass(frozen=True)
class Rule:
    seed: int = 7
    rate: int = 100
    spm_rate: int = 50
    sentinels: tuple[str, str, str] = SENTINELS

    def __post_init__(self):
        p = self.sentinels
        if len(set(p)) < 3 or not all(p) or any(b.startswith(a[i:]) or a[i:].startswith(b) for a in p for b in p for i in range(len(a)) if i or a != b):
            raise ValueError("sentinels must be three strings of which none begins inside another")


def stretches(text: str, size: int = STRETCH) -> Iterator[tuple[int, str]]:
    """(start, part) of a text cut behind line ends into parts of about `size`."""
    at = 0
    while at < len(text):
        end = len(text)
        if end - at > size:
            found = text.rfind("\n", at, at + size) + 1 or text.find("\n", at + size) + 1
            end = found or end
        yield at, text[at:end]
        at = end


def unit_ends(text: str, splitter) -> list[int]:
    """Where each unit ends, in code points."""
    out: list[int] = []
    for at, part in stretches(text):
        out.extend(at + end for _, (_, end) in splitter.pre_tokenize_str(part))
    return out


def splitter():
    from tokenizers import Regex
    from tokenizers.pre_tokenizers import Split

    return Split(Regex(UNITS), behavior="isolated")


def numbers(seed: int, doc_id: int | None) -> list[int]:
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]


def transform_text(text: str, doc_id: int | None, rule: Rule, split) -> tuple[str, str, int, int | None, int | None]:
    """output, form, n, prefix_chars, middle_chars."""
    ends = [0, *unit_ends(text, split)]
    n = len(ends) - 1
    h1, h2, h3, h4 = numbers(rule.seed, doc_id)
    p, s, m = rule.sentinels
    if not text or any(x in text for x in rule.sentinels) or h3 % 100 >= rule.rate:
        return text, "plain", n, None, None
    first, last = sorted((ends[h1 % (n + 1)], ends[h2 % (n + 1)]))
    prefix, middle, suffix = text[:first], text[first:last], text[last:]
    if h4 % 100 < rule.spm_rate:
        return f"{s}{suffix}{p}{prefix}{m}{middle}", "spm", n, first, last - first
    return f"{p}{prefix}{s}{suffix}{m}{middle}", "psm", n, first, last - first


def transform(docs: DataFrame, rule: Rule = Rule(), text_col: str = "text") -> DataFrame:
    """docs with output, form, n, prefix_chars and middle_chars (both null if plain)."""
    kept = [c for c in docs.columns if c.lower() not in MADE]
    schema = StructType([docs.schema[c] for c in kept] + [StructField(c, StringType() if c in ("output", "form") else LongType()) for c in MADE])

    def run(batches):
        split = splitter()
        for batch in batches:
            for start, count in _steps(batch.column(text_col)):
                part = batch.slice(start, count)
                ids, texts = part.column("doc_id").to_pylist(), part.column(text_col).to_pylist()
                made = [transform_text(t or "", i, rule, split) for i, t in zip(ids, texts)]
                new = [pa.array([r[k] for r in made], pa.string() if k < 2 else pa.int64()) for k in range(len(MADE))]
                yield pa.RecordBatch.from_arrays([part.column(c) for c in kept] + new, names=[*kept, *MADE])
            release()

    own = docs.select(*[f"`{c}`" for c in kept])
    return own.mapInArrow(run, schema)


def _steps(texts: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """(start, rows) of runs of about `limit` bytes of text."""
    import pyarrow.compute as pc

    start = held = 0
    for i, n in enumerate(pc.binary_length(texts).to_pylist()):
        if i > start and held + (n or 0) > limit:
            yield start, i - start
            start, held = i, 0
        held += n or 0
    if start < len(texts):
        yield start, len(texts) - start


def restore(output: Column, form: Column, rule: Rule = Rule()) -> Column:
    """The text that an output was made of."""
    p, s, m = rule.sentinels
    place = lambda x: F.locate(x, output)
    between = lambda begin, size, end: F.substring(output, begin + F.lit(size), end - begin - F.lit(size))
    rest = lambda begin, size: F.substring(output, begin + F.lit(size), F.length(output))
    psm = F.concat(between(F.lit(1), len(p), place(s)), rest(place(m), len(m)), between(place(s), len(s), place(m)))
    spm = F.concat(between(place(p), len(p), place(m)), rest(place(m), len(m)), between(F.lit(1), len(s), place(p)))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def digests(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256."""
    made = transform(docs.select("doc_id", "text"), rule)
    sha = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restore(F.col("output"), F.col("form"), rule)).alias("restored_sha256"))


def oracle_sql(rule: Rule = Rule()) -> str:
    """digests() over the view `documents` in DuckDB's SQL."""
    p, s, m = rule.sentinels
    h = lambda k: f"('0x' || substr(hex, {8 * k + 1}, 8))::bigint"
    holds = " or ".join(f"contains(t, '{x}')" for x in rule.sentinels)
    cut = lambda a, b: f"array_to_string(list_slice(lines, {a}, {b}), '')"
    return rf"""
with d as (select doc_id, coalesce(text, '') as t, sha256('{rule.seed}:' || coalesce(doc_id::varchar, '')) as hex from documents),
u as (select *, regexp_extract_all(t, '{UNITS}') as lines from d),
k as (select *, len(lines) as n, {h(0)} % (len(lines) + 1) as c1, {h(1)} % (len(lines) + 1) as c2,
    case when t = '' or {holds} or {h(2)} % 100 >= {rule.rate} then 'plain' when {h(3)} % 100 < {rule.spm_rate} then 'spm' else 'psm' end as form from u),
c as (select doc_id, t, n, form, {cut(1, 'least(c1, c2)')} as pre, {cut('least(c1, c2) + 1', 'greatest(c1, c2)')} as mid, {cut('greatest(c1, c2) + 1', 'n')} as suf from k),
o as (select *, case form when 'psm' then concat('{p}', pre, '{s}', suf, '{m}', mid) when 'spm' then concat('{s}', suf, '{p}', pre, '{m}', mid) else t end as output from c)
select doc_id, n::bigint as n, form, case when form <> 'plain' then length(pre) end::bigint as prefix_chars, case when form <> 'plain' then length(mid) end::bigint as middle_chars,
    sha256(output) as output_sha256, sha256(t) as restored_sha256 from o"""
