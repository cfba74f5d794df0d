"""Queries on tables: preparation, sampling, joins, resume and shards."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as s
from ..operators import cleaning, prep, sampling
from ..sources import writers
from ..sources.readers import missing_to_null, table
from .registry import query, r, round_all, rounded

#: Orders stand in for papers: id, year, citations (every seventh without any), field, status, doi, price.
PAPERS = """papers as (select o_orderkey as id, year(o_orderdate)::bigint as year, case when o_orderkey % 7 = 0 then 0 else floor(o_totalprice / 10000) end::double as citation_count,
    o_orderpriority as field, o_orderstatus as status, (o_custkey % 2)::bigint as doi, o_totalprice as price from orders)"""


def papers(spark, folder):
    cites = F.when(F.col("o_orderkey") % 7 == 0, 0).otherwise(F.floor(F.col("o_totalprice") / 10000)).cast("double")
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.year("o_orderdate").cast("long").alias("year"),
        cites.alias("citation_count"),
        F.col("o_orderpriority").alias("field"),
        F.col("o_orderstatus").alias("status"),
        (F.col("o_custkey") % 2).alias("doi"),
        F.col("o_totalprice").alias("price"),
    )


@query("citation_bins", f"with {PAPERS} select id, case when citation_count >= -0.1 and citation_count <= 0 then '0' when citation_count <= 4 then '1-4' when citation_count <= 12 then '5-12' when citation_count <= 30 then '13-30' else '31+' end as label, (case when citation_count <= 0 then 0 when citation_count <= 4 then 1 when citation_count <= 12 then 2 when citation_count <= 30 then 3 else 4 end)::bigint as ordinal, (citation_count > 5)::int::bigint as cited from papers")
def citation_bins(spark, folder):
    c = F.col("citation_count")
    return papers(spark, folder).select("id", prep.citation_bin(c).alias("label"), prep.citation_ordinal(c).cast("long").alias("ordinal"), s.exceeds(c, 5).cast("long").alias("cited"))


@query("quantile_cap", f"with {PAPERS}, q as (select quantile_cont(citation_count, 0.25) q1, quantile_cont(citation_count, 0.75) q3, quantile_cont(citation_count, 0.95) p95 from papers where citation_count > 0), c as (select case when q3 = q1 then q3 else greatest(q3 + 3 * (q3 - q1), p95) end as cap from q) select id, {r('least(citation_count, cap)')} as capped from papers, c")
def quantile_cap(spark, folder):
    own = papers(spark, folder)
    return own.select("id", rounded(s.clip_upper(F.col("citation_count"), sampling.iqr_cap(own, "citation_count"))).alias("capped"))


def _sql_edges(points: int, where: str, col: str) -> str:
    probs = ", ".join(f"{i}::double / {points - 1}" for i in range(points))
    return f"select list_sort(list_distinct(list_transform(quantile_cont({col}, [{probs}]), lambda x: round_even(x, 0)))) as e from papers where {where}"


@query("quantile_bins", f"with {PAPERS}, e as ({_sql_edges(6, 'true', 'price')}) select id, case " + " ".join(f"when price <= e[{k + 2}] and (price > e[{k + 1}] or ({k} = 0 and price >= e[1])) then concat(e[{k + 1}]::bigint, '-', e[{k + 2}]::bigint)" for k in range(5)) + " end as bin from papers, e")
def quantile_bins(spark, folder):
    own = papers(spark, folder)
    return own.select("id", sampling.plain_bins(own, "price", 5).alias("bin"))


@query("zero_quantile_bins", f"with {PAPERS}, e as ({_sql_edges(5, 'citation_count > 0', 'citation_count')}) select id, case when citation_count <= 0 then '0' " + " ".join(f"when len(e) >= {k + 1} and citation_count <= e[{k + 1}] and citation_count > {'0' if k == 1 else f'e[{k}]'} then case when len(e) = {k + 1} then concat(({'0' if k == 1 else f'e[{k}]'} + 1)::bigint, '+') else concat(({'0' if k == 1 else f'e[{k}]'} + 1)::bigint, '-', e[{k + 1}]::bigint) end" for k in range(1, 5)) + " end as bin from papers, e")
def zero_quantile_bins(spark, folder):
    own = papers(spark, folder)
    return own.select("id", sampling.zero_bins(own, "citation_count", 5).alias("bin"))


_ALLOCATE = """
k as (select {by} concat_ws(' || ', year::varchar, field, status) as stratum, count(*) as capacity from pool group by all),
a as (select *, sum(capacity::double) over ({over}) as total from k),
b as (select *, floor(capacity::double / total * {n})::bigint as base from a),
c as (select *, {n} - sum(base) over ({over}) as remainder, capacity - base as rest from b),
d as (select *, coalesce(rest::double / nullif(sum(rest::double) over ({over}), 0) * remainder, 0) as x from c),
plan as (select *, base + (row_number() over ({over} order by (rest <= 0)::int, x - floor(x) desc, stratum) <= remainder)::int as allocated from d)
"""


@query("allocation", f"with {PAPERS}, pool as (select * from papers), " + _ALLOCATE.format(by="", over="", n=500) + "select stratum, capacity, allocated::bigint as allocated from plan")
def allocation(spark, folder):
    own = papers(spark, folder).withColumn("stratum", sampling.stratum(F.col("year").cast("string"), F.col("field"), F.col("status")))
    return sampling.allocate(own.groupBy("stratum").agg(F.count(F.lit(1)).alias("capacity")), 500)


@query("stratified_sample", f"with {PAPERS}, pool as (select * from papers), " + _ALLOCATE.format(by="", over="", n=500) + ", p as (select id, concat_ws(' || ', year::varchar, field, status) as stratum, row_number() over (partition by year, field, status order by md5(concat(id::varchar, '42')), id) as n from pool) select id, stratum from p join plan using (stratum) where n <= allocated")
def stratified_sample(spark, folder):
    return sampling.stratified_sample(papers(spark, folder), ["year", "field", "status"], 500, "id").select("id", "stratum")


@query("balanced_sample", f"with {PAPERS}, pool as (select * from papers where doi in (0, 1)), " + _ALLOCATE.format(by="doi, ", over="partition by doi", n=200) + ", p as (select id, doi, concat_ws(' || ', year::varchar, field, status) as stratum, row_number() over (partition by doi, year, field, status order by md5(concat(id::varchar, '42')), id) as n from pool) select id, doi from p join plan using (doi, stratum) where n <= allocated")
def balanced_sample(spark, folder):
    return sampling.balanced_sample(papers(spark, folder), "doi", 200, ["year", "field", "status"], "id").select("id", "doi")


_SPLIT = """
n as (select count(*) as n, ceil(count(*) * 200 / 1000.0)::bigint as t, ceil((count(*) - ceil(count(*) * 200 / 1000.0)) * 250 / 1000.0)::bigint as v from papers),
k as (select field as stratum, count(*) as cap from papers group by field),
t1 as (select *, sum(cap::double) over () as total, (select t from n) as want from k),
t2 as (select *, floor(cap::double / total * want)::bigint as base from t1),
t3 as (select *, want - sum(base) over () as remainder, cap - base as rest from t2),
t4 as (select *, rest::double / sum(rest::double) over () * remainder as x from t3),
t5 as (select stratum, cap, base + (row_number() over (order by (rest <= 0)::int, x - floor(x) desc, stratum) <= remainder)::int as n_test from t4),
v1 as (select *, cap - n_test as cap2, sum((cap - n_test)::double) over () as total, (select v from n) as want from t5),
v2 as (select *, floor(cap2::double / total * want)::bigint as base from v1),
v3 as (select *, want - sum(base) over () as remainder, cap2 - base as rest from v2),
v4 as (select *, rest::double / sum(rest::double) over () * remainder as x from v3),
v5 as (select stratum, n_test, base + (row_number() over (order by (rest <= 0)::int, x - floor(x) desc, stratum) <= remainder)::int as n_val from v4),
p as (select id, field as stratum, row_number() over (partition by field order by md5(concat(id::varchar, '42')), id) as i from papers)
"""


@query("split_60_20_20", f"with {PAPERS}, {_SPLIT} select id, case when i <= n_test then 'test' when i <= n_test + n_val then 'val' else 'train' end as split from p join v5 using (stratum)")
def split_60_20_20(spark, folder):
    return sampling.split(papers(spark, folder), "field", "id").select("id", "split")


@query("shard_contiguous", "with n as (select greatest(1, ceil(count(*) / 50.0))::bigint as size from documents) select doc_id, ((row_number() over (order by doc_id) - 1) // size)::bigint as shard from documents, n")
def shard_contiguous(spark, folder):
    return round_all(sampling.shard(table(spark, folder, "documents").select("doc_id"), ["doc_id"], 50))


@query("shard_stride", "select doc_id, ((row_number() over (order by doc_id) - 1) % 50)::bigint as shard from documents")
def shard_stride(spark, folder):
    return round_all(sampling.shard(table(spark, folder, "documents").select("doc_id"), ["doc_id"], 50, contiguous=False))


@query("list_range", "select doc_id from documents qualify row_number() over (order by doc_id) between 11 and 30")
def list_range(spark, folder):
    return sampling.range_of(table(spark, folder, "documents").select("doc_id"), ["doc_id"], 10, 30)


@query("resume_anti_join", "select doc_id from documents where doc_id not in (select doc_id from labels where not coalesce(toxic = 1, false))")
def resume_anti_join(spark, folder):
    return writers.pending(table(spark, folder, "documents").select("doc_id"), table(spark, folder, "labels"), "doc_id", failed="toxic = 1")


@query("label_left_join", "with l as (select doc_id, quality, toxic from labels qualify row_number() over (partition by doc_id order by quality, toxic) = 1) select d.doc_id, quality::bigint as quality, case when quality = 1 then 'good' else 'not good' end as grp from documents d left join l using (doc_id)")
def label_left_join(spark, folder):
    own = cleaning.left_join_first(table(spark, folder, "documents").select("doc_id"), table(spark, folder, "labels"), "doc_id", ["quality", "toxic"])
    return own.select("doc_id", F.col("quality").cast("long").alias("quality"), F.when(F.col("quality") == 1, "good").otherwise("not good").alias("grp"))


@query("unlabelled_anti_join", "select doc_id from documents anti join labels using (doc_id)")
def unlabelled_anti_join(spark, folder):
    return table(spark, folder, "documents").select("doc_id").join(table(spark, folder, "labels"), "doc_id", "left_anti")


@query("key_dedup", "select o_custkey, min(o_orderkey) as o_orderkey from orders group by o_custkey")
def key_dedup(spark, folder):
    return cleaning.drop_duplicate_keys(table(spark, folder, "orders").select("o_custkey", "o_orderkey"), "o_custkey", ["o_orderkey"])


@query("rare_fold", "with v as (select l_orderkey, l_linenumber::bigint as l_linenumber, case when l_suppkey % 3 = 0 then 'Missing' when l_suppkey % 50 = 1 then 'ArXiv' else concat('v', l_suppkey) end as venue from lineitem), c as (select venue, count(*) as n from v group by venue) select l_orderkey, l_linenumber, case when n >= 650 or venue in ('v7', 'Missing') then venue else 'Other' end as venue from v join c using (venue)")
def rare_fold(spark, folder):
    supp = F.col("l_suppkey")
    name = F.when(supp % 3 == 0, None).when(supp % 50 == 1, F.concat(F.lit("my ARXIV "), supp)).otherwise(F.concat(F.lit("v"), supp))
    own = table(spark, folder, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), name.alias("venue"))
    return prep.fold_rare(own, "venue", 650, ["v7", "Missing"], merge=("arxiv", "ArXiv"))


_GAPS = "gaps as (select l_orderkey, l_linenumber::bigint as l_linenumber, case when l_partkey % 11 = 0 then null else l_quantity end as q, case when l_partkey % 13 = 0 then 'NaN'::double else l_extendedprice end as p, l_discount, l_tax, case when l_suppkey % 5 = 0 then null else l_shipmode end as mode from (select *, l_linestatus as l_shipmode from lineitem))"


def gaps(spark, folder):
    part = F.col("l_partkey")
    return table(spark, folder, "lineitem").select(
        "l_orderkey",
        F.col("l_linenumber").cast("long").alias("l_linenumber"),
        F.when(part % 11 != 0, F.col("l_quantity")).alias("q"),
        F.when(part % 13 == 0, float("nan")).otherwise(F.col("l_extendedprice")).alias("p"),
        "l_discount",
        "l_tax",
        F.when(F.col("l_suppkey") % 5 != 0, F.col("l_linestatus")).alias("mode"),
    )


@query("median_impute", f"with {_GAPS}, m as (select median(q) as mq, median(case when isnan(p) then null else p end) as mp from gaps) select l_orderkey, l_linenumber, {r('coalesce(q, mq)')} as q, {r('case when isnan(p) then mp else p end')} as p, {r('l_discount')} as l_discount, {r('l_tax')} as l_tax, coalesce(mode, 'Missing') as mode from gaps, m")
def median_impute(spark, folder):
    return round_all(prep.impute_all(gaps(spark, folder), ["l_orderkey", "l_linenumber"], ["q"]))


@query("ratio_log_features", "select l_orderkey, l_linenumber::bigint as l_linenumber, round(l_extendedprice / nullif(l_quantity, 0), 6) as n_per, round(ln(nullif(l_discount, 0)), 6) + 0.0 as log_discount, 2026 - year(l_shipdate)::bigint as age from lineitem")
def ratio_log_features(spark, folder):
    own = table(spark, folder, "lineitem")
    return own.select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), rounded(s.safe_ratio(F.col("l_extendedprice"), F.col("l_quantity"))).alias("n_per"), rounded(s.safe_log(F.col("l_discount"))).alias("log_discount"), (F.lit(2026) - F.year("l_shipdate")).cast("long").alias("age"))


@query("one_hot", "select o_orderkey, (o_orderstatus = 'O')::int::bigint as o_orderstatus_O, (o_orderstatus = 'P')::int::bigint as o_orderstatus_P from orders")
def one_hot(spark, folder):
    return round_all(prep.one_hot(table(spark, folder, "orders").select("o_orderkey", "o_orderstatus"), ["o_orderstatus"]))


@query("scale_continuous", f"with m as (select avg(l_quantity) as mq, stddev_pop(l_quantity) as sq, avg(l_tax) as mt, stddev_pop(l_tax) as st from lineitem) select l_orderkey, l_linenumber::bigint as l_linenumber, {r('(l_quantity - mq) / sq')} as l_quantity, {r('(l_tax - mt) / st')} as l_tax, (l_returnflag = 'R')::int::bigint as flag from lineitem, m")
def scale_continuous(spark, folder):
    own = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_tax", (F.col("l_returnflag") == "R").cast("int").alias("flag"))
    wide = prep.continuous_columns(own, ["l_quantity", "l_tax", "flag"])
    return round_all(prep.scale(own, prep.scaling(own, wide)))


@query("lenient_coercion", "select event_id, try_cast(json_extract_string(props, '$.k') as double) as k, coalesce(trunc(try_cast(nullif(event_type, 'x') as double)), 0)::bigint as flag, (case when value is null then 5 else greatest(0, least(10, trunc(value))) end)::bigint as clamped, case when value > 50 then 'high' when value <= 50 then 'low' end as side from events")
def lenient_coercion(spark, folder):
    own = table(spark, folder, "events")
    return own.select("event_id", s.to_number(F.get_json_object("props", "$.k")).alias("k"), s.to_flag(F.col("event_type")).cast("long").alias("flag"), s.clamp(F.col("value"), 0, 10, 5, whole=True).cast("long").alias("clamped"), F.when(F.col("value") > 50, "high").when(F.col("value") <= 50, "low").alias("side"))


@query("category_map", "select n_nationkey::bigint as n_nationkey, coalesce(case lower(trim(n_name)) when 'nation_1' then 'One' when 'france' then 'FR' when 'germany' then 'DE' end, trim(n_name)) as name, initcap_name as label from (select *, n_name as initcap_name from nation)")
def category_map(spark, folder):
    own = table(spark, folder, "nation")
    return own.select(F.col("n_nationkey").cast("long").alias("n_nationkey"), s.mapped(F.col("n_name"), {"nation_1": "One", "france": "FR", "germany": "DE"}).alias("name"), F.col("n_name").alias("label"))


@query("missing_tokens", "select doc_id, case when lang in ('', 'NA', 'null', 'None', 'nan') then null else lang end as lang from (select doc_id, case when doc_id % 4 = 0 then 'NA' when doc_id % 4 = 1 then '' else lang end as lang from documents)")
def missing_tokens(spark, folder):
    own = table(spark, folder, "documents").select("doc_id", F.when(F.col("doc_id") % 4 == 0, "NA").when(F.col("doc_id") % 4 == 1, "").otherwise(F.col("lang")).alias("lang"))
    return missing_to_null(own, ["lang"])


@query("union_tables", "select source, count(*) as n from (select 'documents' as source, text from documents union all select 'benchmark', text from benchmark union all select 'conversations', text from conversations) group by source")
def union_tables(spark, folder):
    parts = [table(spark, folder, n).select("text", F.lit(n).alias("source")) for n in ("documents", "benchmark", "conversations")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out.groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("capped_classes", "select o_orderkey, o_orderstatus from orders qualify row_number() over (partition by o_orderstatus order by md5(concat(o_orderkey::varchar, '42')), o_orderkey) <= 100")
def capped_classes(spark, folder):
    return prep.cap_classes(table(spark, folder, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", 100, "o_orderkey")


@query("seeded_shuffle", "select doc_id, row_number() over (order by md5(concat(doc_id::varchar, '42')), doc_id)::bigint as place from documents order by place limit 100")
def seeded_shuffle(spark, folder):
    own = table(spark, folder, "documents").select("doc_id").orderBy(sampling.seeded("doc_id", 42), "doc_id").limit(100)
    from pyspark.sql import Window

    return round_all(own.withColumn("place", F.row_number().over(Window.orderBy(sampling.seeded("doc_id", 42), "doc_id"))))
