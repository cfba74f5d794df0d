"""An interpolated Kneser-Ney model of word trigrams: counts by aggregation, scores by joins on n-grams.

With a fixed discount d, of a word w behind u and v:

    p(w | u v) = max(c(u v w) - d, 0) / c(u v .) + d n(u v .) / c(u v .) p(w | v)
    p(w | v)   = max(n(. v w) - d, 0) / n(. v .) + d n(v .)   / n(. v .) p(w)
    p(w)       = max(n(. w) - d, 0)   / n(. .)   + d n(.)     / n(. .)   / (words + 1)

c counts occurrences and n distinct neighbours, so lower orders ask in how many contexts a word stands and not how often. Where a context is
unknown the lower order alone counts. Words are runs of other characters than white space, A-Z lower-cased; a text's first word
stands behind a start mark and isn't predicted itself.

All tables hold one row for each distinct n-gram or context and come from partial aggregations; every distinct trigram of the scored texts
is looked up once, by equi-joins that adaptive execution may split, and its probability joined back to the counts that each text has of
it. Nothing is broadcast but the two totals. Null and empty texts have no words and the status `empty`, texts of one word `too_short`;
rows that repeat an id are one text with the words of each in turn, unless their texts are told apart by a key; null ids are a text of their own.
An empty training table leaves every word as likely as an unknown one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..functions.batches import bounded, slices
from ..sources.staging import discard, settle

DISCOUNT = 0.75
START = "\u0001"
#: Bytes of text whose trigrams a task holds at a time.
STEP = 1 << 20
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), F.lit(r"([^\x20\x09-\x0D]+)"), 1)


def trigrams(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """keep, u, v, w, m of every word but a text's first; u is the start mark behind the first. Equal rows of a slice of STEP bytes are one with their number m, so add them up."""
    kept = [f"`{c}`" for c in keep or []]
    schema = StructType([docs.schema[c] for c in keep or []] + [StructField(c, StringType()) for c in "uvw"] + [StructField("m", LongType())])
    own = docs.select(*kept, F.col(text_col).cast("string").alias("__text"))

    def run(batches):
        for batch in batches:
            for part in slices(batch, "__text", STEP):
                lists = pc.split_pattern_regex(pc.ascii_lower(pc.fill_null(part.column("__text"), "")), r"[\x20\x09-\x0D]+")
                row, word = pc.list_parent_indices(lists), pc.list_flatten(lists)
                some = pc.not_equal(word, "")
                row, known = np.asarray(row.filter(some)), word.filter(some).dictionary_encode()
                code, names = np.asarray(known.indices).astype(np.int64) + 1, pa.concat_arrays([pa.array([START]), known.dictionary])
                at = np.flatnonzero(row[1:] == row[:-1]) + 1  # words behind another one
                before = np.zeros(len(at), np.int64)
                third = (at > 1) & (row[at - 2] == row[at])
                before[third] = code[at[third] - 2]
                # numbers of pairs, so that a triple fits in 64 bits
                _, pair = np.unique(before * len(names) + code[at - 1], return_inverse=True)
                triple = pair.reshape(-1) * len(names) + code[at]
                order = np.lexsort((triple, row[at])) if keep else np.argsort(triple, kind="stable")
                fresh = np.ones(len(order), bool)
                fresh[1:] = triple[order][1:] != triple[order][:-1]
                if keep:
                    fresh[1:] |= row[at][order][1:] != row[at][order][:-1]
                first = np.flatnonzero(fresh)
                one, times = order[first], np.diff(np.append(first, len(order)))
                made = [part.column(c).take(pa.array(row[at[one]])) for c in keep or []]
                made += [names.take(pa.array(x)) for x in (before[one], code[at[one] - 1], code[at[one]])]
                yield pa.RecordBatch.from_arrays([*made, pa.array(times.astype(np.int64))], names=[*(keep or []), *"uvw", "m"])

    bounded(docs.sparkSession)
    return own.mapInArrow(run, schema)


@dataclass
class Model:
    """The model's tables: c3(u, v, w, c), x3(u, v, t, d), c2(v, w, c), x2(v, t, d), c1(w, c), and the totals of c1. They are written; drop() deletes them."""

    c3: DataFrame
    x3: DataFrame
    c2: DataFrame
    x2: DataFrame
    c1: DataFrame
    total: int
    words: int
    discount: float

    def drop(self) -> None:
        discard(self.c3, self.x3, self.c2, self.x2, self.c1)


def fit(docs: DataFrame, text_col: str = "text", discount: float = DISCOUNT) -> Model:
    count = F.count(F.lit(1)).alias("c")
    context = [F.sum("c").alias("t"), F.count(F.lit(1)).alias("d")]
    c3 = settle(trigrams(docs, text_col).groupBy("u", "v", "w").agg(F.sum("m").alias("c")), "trigrams")
    c2 = settle(c3.groupBy("v", "w").agg(count), "bigrams")
    c1 = settle(c2.groupBy("w").agg(count), "words")
    total, n = c1.agg(F.sum("c"), F.count(F.lit(1))).first()
    return Model(c3, settle(c3.groupBy("u", "v").agg(*context), "contexts"), c2, settle(c2.groupBy("v").agg(*context), "contexts"), c1, total or 0, n, discount)


def probabilities(grams: DataFrame, m: Model) -> DataFrame:
    """Adds p to distinct grams(u, v, w); a written table. Each join is written before the next one shuffles, so that the disk holds the shuffles of one join at a time."""
    d = F.lit(m.discount)

    def level(c: str, t: str, k: str, lower: Column) -> Column:
        seen = F.greatest(F.coalesce(F.col(c), F.lit(0)) - d, F.lit(0.0)) / F.col(t) + d * F.col(k) / F.col(t) * lower
        return F.when(F.col(t).isNull(), lower).otherwise(seen)

    def side(df: DataFrame, keys: list[str], **names: str) -> tuple[DataFrame, Column]:
        out = df.select(*[F.col(k).alias(f"__{k}") for k in keys], *[F.col(c).alias(n) for n, c in names.items()])
        same = F.lit(True)
        for k in keys:
            same = same & (F.col(k) == F.col(f"__{k}"))
        return out, same

    def joined(out: DataFrame, df: DataFrame, keys: list[str], **names: str) -> DataFrame:
        table, same = side(df, keys, **names)
        return out.join(table, same, "left").drop(*[f"__{k}" for k in keys])

    def step(out: DataFrame, df: DataFrame, keys: list[str], **names: str) -> DataFrame:
        return settle(joined(out, df, keys, **names), "looked-up")

    unknown = F.lit(1.0 / (m.words + 1))
    p1 = (F.greatest(F.coalesce(F.col("c1"), F.lit(0)) - d, F.lit(0.0)) + d * F.lit(m.words) * unknown) / F.lit(float(m.total)) if m.total else unknown
    own = step(grams, m.c3, ["u", "v", "w"], c3="c")
    # the lower orders once for each pair of words
    seen = step(own.select("v", "w").distinct(), m.c2, ["v", "w"], c2="c")
    behind = step(seen, m.x2, ["v"], t2="t", k2="d")
    discard(seen)
    pairs = settle(joined(behind, m.c1, ["w"], c1="c").select("v", "w", level("c2", "t2", "k2", p1).alias("p2")), "pairs")
    discard(behind)
    whole = step(own, m.x3, ["u", "v"], t3="t", k3="d")
    discard(own)
    out = settle(joined(whole, pairs, ["v", "w"], p2="p2").select("u", "v", "w", level("c3", "t3", "k3", F.col("p2")).alias("p")), "probabilities")
    discard(whole, pairs)
    return out


def perplexity(docs: DataFrame, m: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, n_pred_tokens, neg_log_likelihood, perplexity, status of each text."""
    own = settle(trigrams(docs, text_col, [id_col]), "scored-grams")
    p = probabilities(own.select("u", "v", "w").distinct(), m).withColumnsRenamed({k: f"__{k}" for k in "uvw"})
    same = F.expr("u = __u and v = __v and w = __w")
    sums = own.join(p, same).groupBy(F.col(id_col).alias("__id")).agg(F.sum("m").alias("n_pred_tokens"), (-F.sum(F.col("m") * F.log("p"))).alias("neg_log_likelihood"))
    sizes = docs.groupBy(id_col).agg(F.sum(F.size(words(F.col(text_col)))).cast("long").alias("n_tokens"))
    out = sizes.join(sums, F.col(id_col).eqNullSafe(F.col("__id")), "left")
    status = F.when(F.col("n_tokens") < 1, "empty").when(F.col("neg_log_likelihood").isNull(), "too_short").otherwise("ok")
    ratio = F.exp(F.col("neg_log_likelihood") / F.col("n_pred_tokens"))
    return out.select(id_col, "n_tokens", F.coalesce("n_pred_tokens", F.lit(0)).alias("n_pred_tokens"), "neg_log_likelihood", ratio.alias("perplexity"), status.alias("status"))


def oracle_sql(source: str, training: str, discount: float = DISCOUNT) -> str:
    """perplexity() of source(doc_id, text) under a model of training(doc_id, text), relations of DuckDB, unrounded; ends in a relation `scored`."""
    grams = lambda rel: f"select doc_id, u, v, w from (select doc_id, ws[i - 1] as v, ws[i] as w, case when i = 2 then chr(1) else ws[i - 2] end as u from (select doc_id, ws, unnest(range(2, len(ws) + 1)) as i from {rel} where len(ws) > 1))"
    cut = lambda rel: f"select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x20\\x09-\\x0D]+') as ws from {rel}"
    return f"""source_words as ({cut(source)}), training_words as ({cut(training)}),
c3 as (select u, v, w, count(*) as c from ({grams('training_words')}) group by all), x3 as (select u, v, sum(c) as t, count(*) as d from c3 group by all),
c2 as (select v, w, count(*) as c from c3 group by all), x2 as (select v, sum(c) as t, count(*) as d from c2 group by all),
c1 as (select w, count(*) as c from c2 group by all), x1 as (select sum(c) as t, count(*) as d from c1),
own as (select doc_id, u, v, w, count(*) as m from ({grams('source_words')}) group by all),
p1 as (select own.*, (greatest(coalesce(c1.c, 0) - {discount}, 0) + {discount} * x1.d / (x1.d + 1)) / x1.t as p from own left join c1 using (w), x1),
p2 as (select p1.* exclude (p), case when x2.t is null then p else greatest(coalesce(c2.c, 0) - {discount}, 0) / x2.t + {discount} * x2.d / x2.t * p end as p from p1 left join c2 using (v, w) left join x2 using (v)),
p3 as (select p2.* exclude (p), case when x3.t is null then p else greatest(coalesce(c3.c, 0) - {discount}, 0) / x3.t + {discount} * x3.d / x3.t * p end as p from p2 left join c3 using (u, v, w) left join x3 using (u, v)),
nll as (select doc_id, sum(m)::bigint as n_pred_tokens, -sum(m * ln(p)) as neg_log_likelihood from p3 group by doc_id),
scored as (select doc_id, n_tokens, coalesce(n_pred_tokens, 0)::bigint as n_pred_tokens, neg_log_likelihood, exp(neg_log_likelihood / n_pred_tokens) as perplexity, case when n_tokens < 1 then 'empty' when neg_log_likelihood is null then 'too_short' else 'ok' end as status
    from (select doc_id, sum(len(ws))::bigint as n_tokens from source_words group by doc_id) left join nll using (doc_id))"""
