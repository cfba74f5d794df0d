"""Queries that write files, read them back, and lay out columns; each writes to a folder of its own in the shared one."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import scalars as s
from ..operators import cleaning, judging, papers, prep, sampling, stats
from ..sources import readers, versions, writers
from ..sources.readers import table
from ..sources.staging import discard, settle, shared_dir
from .registry import query, r, round_all
from .tabular import _GAPS, _SPLIT, PAPERS, gaps
from .tabular import papers as paper_rows
from .texts import _STATS, _WINDOWS, length_scorer, sql_squeeze


def _place(spark, tag):
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def _csv(spark, folder):
    """Orders as CSV, with quotes, separators and line breaks in a cell and words for missing values in another."""
    key = F.col("o_orderkey")
    note = F.concat("o_orderpriority", F.lit(', "'), "o_orderstatus", F.lit('"\nnext line'))
    gap = F.when(key % 3 == 0, "NA").when(key % 3 == 1, "").otherwise(F.col("o_orderstatus"))
    path = _place(spark, "csv")
    writers.write_csv(table(spark, folder, "orders").select("o_orderkey", "o_totalprice", note.alias("note"), gap.alias("gap")), path)
    return path


_NOTE = """concat(o_orderpriority, ', "', o_orderstatus, '"', chr(10), 'next line')"""
_GAP = "case when o_orderkey % 3 = 2 then o_orderstatus end"


@query("csv_typed", f"select o_orderkey, {r('o_totalprice')} as o_totalprice, {_NOTE} as note, {_GAP} as gap from orders")
def csv_typed(spark, folder):
    """A CSV with types found in its cells."""
    return round_all(readers.read_csv(spark, _csv(spark, folder), strings=["note", "gap"]))


@query("csv_strings", f"select o_orderkey::varchar as o_orderkey, {_GAP} as gap from orders")
def csv_strings(spark, folder):
    """Two columns of a CSV, all as texts."""
    return readers.read_csv(spark, _csv(spark, folder), columns=["o_orderkey", "gap"], all_strings=True)


@query("text_files", "select item_id, case when item_id % 3 = 0 then 'test' else 'train' end as split, md5(text) as digest from benchmark")
def text_files(spark, folder):
    """A file for each benchmark item below the folders of two splits."""
    path = _place(spark, "texts")
    own = table(spark, folder, "benchmark").select(F.when(F.col("item_id") % 3 == 0, "test").otherwise("train").alias("split"), "item_id", "text")
    own.write.partitionBy("split", "item_id").option("lineSep", "\n").text(path)
    found = readers.read_texts(spark, path, splits=["split=train", "split=test"])
    whole = F.regexp_replace("text", "\n$", "")
    return found.select(F.regexp_extract("path", r"item_id=(\d+)", 1).cast("long").alias("item_id"), F.split_part("split", F.lit("="), F.lit(2)).alias("split"), F.md5(whole).alias("digest"))


@query("json_files", "select item_id, len(string_split(text, chr(10)))::bigint as lines, md5(text) as digest from benchmark")
def json_files(spark, folder):
    """A page JSON file for each benchmark item."""
    path = _place(spark, "papers")
    writers.write_json(table(spark, folder, "benchmark").select("item_id", papers.lines_as_pages(F.col("text")).alias("pages")).repartition("item_id"), path)
    lines = spark.read.schema(f"item_id long, {papers.PAGES_SCHEMA}").json(path)
    alone = _place(spark, "papers")
    lines.write.partitionBy("item_id").json(alone)
    found = readers.read_papers(spark, f"{alone}/*")
    texts = F.transform(F.flatten(F.transform(F.flatten(F.transform("pages", lambda p: p["boxes"])), lambda b: b["textlines"])), lambda x: x["spans"][0]["text"])
    own = found.select(F.regexp_extract("path", r"item_id=(\d+)", 1).cast("long").alias("item_id"), texts.alias("x"))
    return own.select("item_id", F.size("x").cast("long").alias("lines"), F.md5(F.array_join("x", "\n")).alias("digest"))


_ENDINGS = [".json.sections.txt", ".sections.txt", ".txt", ".json.sections", ".json"]


@query("path_ids", "select doc_id, concat('p.', doc_id) as paper_id from documents")
def path_ids(spark, folder):
    """The ids in paths of five endings."""
    ending = F.element_at(F.array(*[F.lit(e) for e in _ENDINGS]), (F.pmod("doc_id", F.lit(5)) + 1).cast("int"))
    path = F.concat(F.lit("/data/train.txt/p."), F.col("doc_id"), ending)
    return table(spark, folder, "documents").select("doc_id", readers.path_id(path).alias("paper_id"))


@query("split_sinks", f"with {PAPERS}, {_SPLIT} select case when i <= n_test then 'test' when i <= n_test + n_val then 'val' else 'train' end as split, count(*) as n, sum(id)::bigint as ids from p join v5 using (stratum) group by 1")
def split_sinks(spark, folder):
    path = _place(spark, "splits")
    writers.write_splits(sampling.split(paper_rows(spark, folder), "field", "id"), path)
    return spark.read.parquet(path).groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("ids"))


@query("audit_sink", _STATS + "select doc_id, removal_reason from x")
def audit_sink(spark, folder):
    """Kept and removed documents, read back from the two sinks."""
    path = _place(spark, "audit")
    judged = settle(cleaning.classify(table(spark, folder, "documents")).select("doc_id", "removal_reason"), "judged")
    writers.write_audited(judged.where("removal_reason = ''").select("doc_id"), judged.where("removal_reason <> ''"), path)
    discard(judged)
    gone = spark.read.schema("doc_id long, removal_reason string").parquet(f"{path}/removed")
    return spark.read.schema("doc_id long").parquet(f"{path}/kept").withColumn("removal_reason", F.lit("")).unionByName(gone)


@query("run_counters", _WINDOWS + "select case when len(a.w) < 1 then 'empty' when nll is null then 'too_short' else 'ok' end as status, count(*) as n from a left join c using (doc_id) group by 1")
def run_counters(spark, folder):
    own = table(spark, folder, "documents").select("doc_id", "text")
    return writers.run_counts(judging.perplexity(own, length_scorer, window=64))


@query("versioned_sink", "select o_orderkey, o_orderstatus from orders")
def versioned_sink(spark, folder):
    """Orders through a sink of versions: an overwrite, batches of a resumed run of which one comes twice, and the last version read back."""
    path = _place(spark, "versions")
    own = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus")
    versions.overwrite(own.where("o_orderstatus = 'none'"), path)
    stage = lambda d: d
    versions.resume(own, stage, path, "o_orderkey", parts=3)
    versions.append(own.where("o_orderkey % 2 = 0"), path, "run/3/1")
    versions.resume(own, stage, path, "o_orderkey", parts=3)
    return versions.read(spark, path)


@query("renamed_columns", "select o_orderkey as paper_id, o_orderstatus as status, o_totalprice as price from orders where o_orderkey % 4 <> 0")
def renamed_columns(spark, folder):
    """Renamed, without columns that would give the target away, without rows that lack a price."""
    own = table(spark, folder, "orders").withColumn("o_totalprice", F.when(F.col("o_orderkey") % 4 != 0, F.col("o_totalprice")))
    own = prep.rename(own, {"o_orderkey": "paper_id", "o_orderstatus": "status", "o_totalprice": "price", "absent": "x"})
    return prep.drop_leaky(own, ["o_custkey", "o_orderdate", "o_orderpriority", "absent"]).dropna(subset=["price"])


_LAYOUT = {
    "targets last": ["o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority", "o_totalprice", "o_orderstatus"],
    "moved": ["o_orderkey", "o_orderdate", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"],
    "numbers": ["o_orderkey", "o_custkey", "o_totalprice"],
    "prefix": ["o_orderkey", "o_orderstatus", "o_orderdate", "o_orderpriority"],
    "features": ["a_b", "a_b_1", "_", "a_b_2"],
}


_COUNTED = lambda c: f"(select count({c}) from orders)" if c.startswith("o_") else "null::bigint"


@query("column_layout", " union all ".join(f"select '{k}' as layout, {i}::bigint as place, '{c}' as name, {_COUNTED(c)} as known" for k, names in _LAYOUT.items() if k != "prefix" for i, c in enumerate(names)) + " union all select 'prefix', (row_number() over ()) - 1, column_name, case column_name " + " ".join(f"when '{c}' then {_COUNTED(c)}" for c in ("o_orderkey", "o_orderstatus", "o_orderdate", "o_orderpriority")) + " end from (describe orders) where starts_with(column_name, 'o_order')")
def column_layout(spark, folder):
    """Orders of columns, numeric columns, columns with a prefix, feature names made unique; and in how many rows a column is known."""
    own = table(spark, folder, "orders")
    known = own.agg(*[F.count(c).alias(c) for c in own.columns]).first().asDict()
    laid = {
        "targets last": prep.targets_last(own, ["o_totalprice", "absent", "o_orderstatus"]).columns,
        "moved": prep.move_after(own, "o_orderdate", "o_orderkey").columns,
        "numbers": s.numeric_columns(own),
        "prefix": s.with_prefix(own, "o_order"),
        "features": prep.unique_feature_names(["a b", "a[b", "<>", "a_b"]),
    }
    return spark.createDataFrame([(k, i, c, known.get(c)) for k, names in laid.items() for i, c in enumerate(names)], "layout string, place long, name string, known long")


_FIELD = "case o_orderkey % 4 when 0 then ' physics ' when 1 then 'BIOLOGY' when 2 then 'Poetry' end"
_POOL = f"select o_orderkey as id, year(o_orderdate)::double + 12 as year, case when o_orderkey % 5 > 0 then o_totalprice end as citations, {_FIELD} as category1, case when o_custkey % 3 = 2 then null else o_custkey % 3 end as has_doi from orders"


@query("citation_pool", f"select id, year, {r('citations')} as citation_count, case lower(trim(category1)) when 'physics' then 'Physics' when 'biology' then 'Biology' end as field, has_doi::double as doi from ({_POOL}) where has_doi in (0, 1) and year between 2005 and 2021 and citations is not null and lower(trim(category1)) in ('physics', 'biology')")
def citation_pool(spark, folder):
    """The rows that may be sampled: known citations and DOI flag, year and field in range."""
    key = F.col("o_orderkey")
    field = F.when(key % 4 == 0, " physics ").when(key % 4 == 1, "BIOLOGY").when(key % 4 == 2, "Poetry")
    doi = F.when(F.col("o_custkey") % 3 != 2, F.col("o_custkey") % 3)
    own = table(spark, folder, "orders").select(key.alias("id"), (F.year("o_orderdate") + 12).alias("Year"), F.when(key % 5 > 0, F.col("o_totalprice")).alias("citationCount"), field.alias("category1"), doi.alias("has_doi"))
    return round_all(sampling.citation_pool(own).select("id", "year", "citation_count", "field", "doi"))


@query("publication_flags", "select o_orderkey, " + ", ".join(f"contains(lower(coalesce(kind, '')), '{w}')::int::bigint as {n}" for n, w in (("is_journal_article", "journalarticle"), ("is_conference", "conference"), ("is_review", "review"), ("is_book", "book"))) + " from (select o_orderkey, case o_orderkey % 5 when 0 then 'JournalArticle, Review' when 1 then 'Conference' when 2 then 'BookSection' when 3 then 'Journal Article' end as kind from orders)")
def publication_flags(spark, folder):
    key = F.col("o_orderkey") % 5
    kind = F.when(key == 0, "JournalArticle, Review").when(key == 1, "Conference").when(key == 2, "BookSection").when(key == 3, "Journal Article")
    return round_all(table(spark, folder, "orders").select("o_orderkey", *[c.alias(n) for n, c in prep.publication_flags(kind).items()]))


@query("derived_features", f"select o_orderkey, {r('o_custkey / nullif(o_orderkey % 4, 0)::double')} as words_per_sentence, {r('ln(case when o_totalprice > 50000 then o_totalprice end)')} as log_perplexity, 2026 - year(o_orderdate)::bigint as paper_age from orders")
def derived_features(spark, folder):
    """Ratios, logarithms and ages; a ratio whose inputs aren't there (chars_per_word) isn't made."""
    price = F.col("o_totalprice")
    own = table(spark, folder, "orders").select("o_orderkey", F.col("o_custkey").alias("n_words"), (F.col("o_orderkey") % 4).alias("n_sentences"), F.when(price > 50000, price).otherwise(0.0).alias("perplexity"), F.year("o_orderdate").alias("year"))
    return round_all(prep.derived_features(own, 2026).drop("n_words", "n_sentences", "perplexity", "year"))


@query("missing_flags", f"with {_GAPS}, m as (select median(q) as mq from gaps) select l_orderkey, l_linenumber, (q is null or mode is null)::int::bigint as abstract_readability_missing, {r('coalesce(q, mq)')} as q, coalesce(mode, 'Missing') as mode from gaps, m")
def missing_flags(spark, folder):
    """A flag for what was missing before it is filled."""
    return round_all(prep.impute_all(gaps(spark, folder).drop("p", "l_discount", "l_tax"), ["l_orderkey", "l_linenumber"], ["q"], readability=["q", "mode", "absent"]))


_GROUPS = {"keys": ["l_orderkey", "l_partkey", "l_nothing"], "money": ["l_extendedprice", "l_tax"], "gone": ["x"]}


_KNOWN = {"keys": "l_orderkey is not null or l_partkey is not null", "money": "l_extendedprice is not null or l_tax is not null", "gone": "false"}


@query("feature_overview", " union all ".join(f"select '{g}' as feature_group, {len(c)}::bigint as expected, (select count(*) from (describe lineitem) where column_name in ({', '.join(repr(x) for x in c)})) as available, count(*) filter ({_KNOWN[g]}) as known from lineitem" for g, c in _GROUPS.items()))
def feature_overview(spark, folder):
    return round_all(stats.overview(table(spark, folder, "lineitem"), _GROUPS))


@query("failed_answers", "select conv_id, turn::bigint as turn, len(list_filter([case conv_id % 3 when 0 then 'ERROR: x' when 1 then 'It failed to parse.' else 'fine' end, case when turn % 4 = 3 then 'over the maximum model length' else 'ok' end], lambda v: regexp_matches(v, 'ERROR:|failed to parse|maximum model length'))) > 0 as failed from conversations")
def failed_answers(spark, folder):
    """Answers whose reasons say that they failed."""
    conv = F.col("conv_id") % 3
    reasons = F.array(F.when(conv == 0, "ERROR: x").when(conv == 1, "It failed to parse.").otherwise("fine"), F.when(F.col("turn") % 4 == 3, "over the maximum model length").otherwise("ok"))
    return table(spark, folder, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), judging.is_error(reasons).alias("failed"))


_HEADS = ["References", " 7.1 BIBLIOGRAPHY ", "works  cited", "2 Reference List", "Literature cited.", "References and notes", "12"]
_HEAD_RULE = r"(?i)^\s*(?:(?:\d+(?:\.\d+)*)?\s*(?:references|bibliography|works\s+cited|literature\s+cited|reference\s+list))\s*$"
_LINES = f"select doc_id, list_concat(string_split(text, chr(10)), list_concat([[{', '.join(repr(h) for h in _HEADS)}][doc_id % 7 + 1]], string_split(text, chr(10)))) as x from documents where text is not null"


@query("references_cut", f"with l as ({_LINES}), h as (select *, list_position(list_transform(x, lambda v: regexp_matches(trim(v), '{_HEAD_RULE}')), true) as pos from l), c as (select doc_id, case when pos > 0 then x[1 : pos - 1] else x end as y from h) select doc_id, len(y)::bigint as lines, md5(array_to_string(y, chr(10))) as digest from c")
def references_cut(spark, folder):
    """Documents twice, with a line between that may be the header of a list of references: what is before it."""
    head = F.element_at(F.array(*[F.lit(h) for h in _HEADS]), (F.pmod("doc_id", F.lit(7)) + 1).cast("int"))
    lines = F.concat(F.split("text", "\n"), F.array(head), F.split("text", "\n"))
    items = F.transform(lines, lambda x: F.struct(x.alias("text"), F.lit("text").alias("kind")))
    own = table(spark, folder, "documents").where("text is not null").select("doc_id", F.transform(papers.cut_references(items), lambda x: x["text"]).alias("y"))
    return own.select("doc_id", F.size("y").cast("long").alias("lines"), F.md5(F.array_join("y", "\n")).alias("digest"))


_LINE = f"""regexp_replace(regexp_replace({sql_squeeze("replace(text, chr(173), '')")}, '([A-Za-z])- ([A-Za-z])', '\\1\\2', 'g'), '([A-Za-z])- ([A-Za-z])', '\\1\\2', 'g')"""


@query("kept_boxes", f"select doc_id, (case when trim(text) <> '' then 2 else 0 end)::bigint as lines, case when trim(text) <> '' then 'text|section-header' else '' end as kinds, md5(case when trim(text) <> '' then concat({_LINE}, '|', {_LINE}) else '' end) as digest from documents where text is not null")
def kept_boxes(spark, folder):
    """Of four boxes with a document's text the two of the kept classes, in page order."""
    spans = F.array(F.struct(F.array(F.struct(F.col("text"))).alias("spans")))
    pages = F.array(F.struct(F.array(*[F.struct(F.lit(k).alias("boxclass"), spans.alias("textlines")) for k in ("page-header", "text", "table", "section-header")]).alias("boxes")))
    own = table(spark, folder, "documents").where("text is not null").select("doc_id", papers.page_items(pages).alias("x"))
    return own.select("doc_id", F.size("x").cast("long").alias("lines"), F.array_join(F.transform("x", lambda i: i["kind"]), "|").alias("kinds"), F.md5(F.array_join(F.transform("x", lambda i: i["text"]), "|")).alias("digest"))
