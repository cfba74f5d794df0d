"""Substring dedup on sliding runs of sentences.

A sentence ends with a word that ends in . ! or ?, or at the end of a line. From each sentence runs the shortest
span of at least MIN_SENTENCES sentences and MIN_WORDS words (a first sentence of LONE_WORDS words is a span by
itself, so that passages of one or two long sentences are found too; lone_words = NEVER leaves runs of several sentences alone); all spans of all documents meet by hash, and of
each repeated span every occurrence but the first, in the order of (doc_id, sentence), has its sentences
removed. Spans slide by one sentence, so a passage is found whatever stands around it, and two documents that
share one ordinary sentence keep it. Where a text repeats itself without a gap, spans overlap the first one and its
sentences after the very first go too. A-Z case and white space don't matter.

Hashes are counted with partial aggregation, and only repeated ones are joined back, on the hash, by an equi-join that
adaptive execution may split; a passage in a third of all documents has one row per occurrence and no pairs.

Null texts stay null and have no sentences; texts shorter than a span are left alone, as are rows with a null
doc_id, which take no part. Rows that repeat a doc_id and its text have the same occurrences and keep them
alike; of two different texts under one doc_id, each loses what either would. Other columns are kept; of clashing
names the operator's wins. Texts of any length are cut into sentences a piece at a time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import mix, rows_of, settle, text_slices, words

MIN_SENTENCES, MIN_WORDS, LONE_WORDS = 2, 16, 24
NEVER = 1 << 62
#: Spans to remove that are broadcast to the documents (about 24 bytes each); with more, a shuffle join brings them.
BROADCAST_SPANS = 500_000

_U = np.uint64
_ENDS = np.zeros(256, bool)
_ENDS[list(b".!?")] = True


def sentences(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, first byte, words and hash of each sentence of texts laid end to end."""
    starts, ends, hashes = words(data, offsets)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0, np.uint64)
    row = rows_of(starts, offsets)
    begins = np.ones(len(starts), bool)
    begins[1:] = _ENDS[data[ends[:-1] - 1]] | (row[1:] != row[:-1])
    lines = np.searchsorted(starts, np.flatnonzero(data == 10))
    begins[lines[lines < len(starts)]] = True
    first = np.flatnonzero(begins)
    size = np.diff(np.concatenate([first, [len(starts)]]))
    place = np.arange(len(starts)) - np.repeat(first, size)
    each = mix(hashes + place.astype(np.uint64) * _U(0x9E3779B97F4A7C15))
    return row[first], starts[first], size, mix(np.add.reduceat(each, first) + size.astype(np.uint64))


def spans(row: np.ndarray, size: np.ndarray, hashes: np.ndarray, min_sentences: int = MIN_SENTENCES, min_words: int = MIN_WORDS, lone_words: int = LONE_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First sentence, number of sentences and hash of each span."""
    n = len(row)
    total, count, out = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.uint64)
    live, step = np.arange(n), 0
    done = []
    while len(live):
        at = live + step
        fits = at < n
        live, at = live[fits], at[fits]
        same = row[at] == row[live]
        live, at = live[same], at[same]
        total[live] += size[at]
        count[live] += 1
        out[live] += mix(hashes[at] + _U(step * 0xA24BAED4963EE407 % (1 << 64)))
        step += 1
        whole = (count[live] >= min_sentences) & (total[live] >= min_words) | (total[live] >= lone_words)
        done.append(live[whole])
        live = live[~whole]
    first = np.concatenate(done) if done else np.zeros(0, np.int64)
    return first, count[first], mix(out[first] + count[first].astype(np.uint64))


def all_spans(docs: DataFrame, **bounds: int) -> DataFrame:
    """span (hash), doc_id, at (place of the first sentence), n (sentences)."""

    def run(batches):
        for batch in batches:
            for part, data, offsets in text_slices(batch, "text"):
                row, _, size, hashes = sentences(data, offsets)
                first, count, h = spans(row, size, hashes, **bounds)
                head = np.searchsorted(row, row)
                ids = part.column("doc_id").take(pa.array(row[first]))
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), ids, pa.array((first - head[first]).astype(np.int32)), pa.array(count.astype(np.int32))], names=["span", "doc_id", "at", "n"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    return own.mapInArrow(run, "span long, doc_id long, at int, n int")


def repeats(docs: DataFrame, **bounds: int) -> DataFrame:
    """doc_id, cuts: the non-first repeated spans of each document, as an array of (at, n)."""
    found = settle(all_spans(docs, **bounds), "spans")
    seen = found.groupBy("span").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("doc_id", "at")).alias("first")).where("c > 1")
    seen = settle(seen.select("span", F.col("first.doc_id").alias("first_doc"), F.col("first.at").alias("first_at")), "repeated")
    later = found.join(seen, "span").where("doc_id <> first_doc or at <> first_at")
    return later.groupBy("doc_id").agg(F.collect_set(F.struct("at", "n")).alias("cuts"))  # at most one for each sentence


def remove_repeats(docs: DataFrame, broadcast_spans: int = BROADCAST_SPANS, **bounds: int) -> DataFrame:
    """docs with the text without repeated spans, and n_sentences, n_removed. bounds: min_sentences, min_words, lone_words."""
    kept = [c for c in docs.columns if c.lower() not in ("n_sentences", "n_removed", "cuts")]
    own = docs.select(*[f"`{c}`" for c in kept])
    cuts = settle(repeats(own, **bounds), "cuts")
    small = (cuts.agg(F.sum(F.size("cuts"))).first()[0] or 0) <= broadcast_spans
    joined = own.join((F.broadcast(cuts) if small else cuts).withColumnRenamed("doc_id", "__doc"), F.col("doc_id") == F.col("__doc"), "left").drop("__doc")

    def run(batches):
        for batch in batches:
            for part, data, offsets in text_slices(batch, "text"):
                row, start, _, _ = sentences(data, offsets)
                n = len(offsets) - 1
                head, tail = np.searchsorted(row, np.arange(n)), np.searchsorted(row, np.arange(n), side="right")
                texts, removed = part.column("text").to_pylist(), np.zeros(n, np.int64)
                for i, own_cuts in enumerate(part.column("cuts").to_pylist()):
                    if not own_cuts or texts[i] is None:
                        continue
                    gone = np.zeros(tail[i] - head[i], bool)
                    for c in own_cuts:
                        gone[c["at"] : c["at"] + c["n"]] = True
                    bounds = np.append(start[head[i] : tail[i]], offsets[i + 1])
                    pieces = [data[offsets[i] : bounds[0]].tobytes()] + [data[bounds[k] : bounds[k + 1]].tobytes() for k in np.flatnonzero(~gone)]
                    texts[i] = b"".join(pieces).decode()
                    removed[i] = gone.sum()
                columns = [pa.array(texts, pa.string()) if c.lower() == "text" else part.column(c) for c in kept]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(tail - head, pa.int64()), pa.array(removed)], names=[*kept, "n_sentences", "n_removed"])

    schema = StructType([docs.schema[c] for c in kept] + [StructField("n_sentences", LongType()), StructField("n_removed", LongType())])
    return joined.mapInArrow(run, schema)


def oracle_sql() -> str:
    """remove_repeats() over the view `documents` in DuckDB's SQL: doc_id, text, n_sentences, n_removed."""
    space, upper, lower = r"[\x20\x09-\x0D]", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return rf"""
with d as (select row_number() over () as rid, doc_id, text from documents),
p as (select rid, doc_id, unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]+{space}*')) as piece, unnest(range(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+{space}*')))) as i from d),
w as (select *, regexp_replace(piece, '{space}+$', '') as word, regexp_matches(piece, '[.!?]{space}*$') or contains(piece, chr(10)) as stops from p),
n as (select *, coalesce(sum(stops::int) over (partition by rid order by i rows between unbounded preceding and 1 preceding), 0) as s from w),
sent as (select rid, doc_id, s, string_agg(piece, '' order by i) as raw, string_agg(translate(word, '{upper}', '{lower}'), ' ' order by i) as key, count(*) as words from n group by rid, doc_id, s),
total as (select *, sum(words) over (partition by rid order by s) as upto from sent),
run as (select a.rid, a.doc_id, a.s, min(b.s) as e from total a join total b on a.rid = b.rid and b.s between a.s and a.s + {LONE_WORDS - 1}
    where a.doc_id is not null and (b.upto - a.upto + a.words >= {LONE_WORDS} or b.s - a.s + 1 >= {MIN_SENTENCES} and b.upto - a.upto + a.words >= {MIN_WORDS}) group by a.rid, a.doc_id, a.s),
span as (select r.rid, r.doc_id, r.s, r.e, md5(string_agg(t.key, chr(1) order by t.s)) as h from run r join total t on t.rid = r.rid and t.s between r.s and r.e group by r.rid, r.doc_id, r.s, r.e),
seen as (select *, first_value(doc_id) over k as first_doc, first_value(s) over k as first_s from span window k as (partition by h order by doc_id, s)),
cut as (select distinct doc_id, s as a, e as b from seen where doc_id <> first_doc or s <> first_s),
gone as (select distinct t.rid, t.s from total t join cut on cut.doc_id = t.doc_id and t.s between cut.a and cut.b),
left_over as (select t.rid, count(*) as n_sentences, count(g.s) as n_removed, coalesce(string_agg(t.raw, '' order by t.s) filter (g.s is null), '') as kept from total t left join gone g on g.rid = t.rid and g.s = t.s group by t.rid)
select d.doc_id, case when n_removed > 0 then concat(regexp_extract(text, '^{space}*'), kept) else text end as text, coalesce(n_sentences, 0)::bigint as n_sentences, coalesce(n_removed, 0)::bigint as n_removed from d left join left_over using (rid)"""
