"""Queries on documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import cleaning, grammar, judging, language_model, papers, readability, spelling
from ..sources.readers import table
from .registry import query, r, round_all

WS = r"[\s\x0b\x1c-\x1f\x85\p{Z}]+"


def sql_squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, '{WS}', ' ', 'g'))"


def sql_clean(x: str) -> str:
    x = f"regexp_replace(coalesce({x}, ''), '<[^>]+>', ' ', 'g')"
    x = rf"regexp_replace({x}, '\\[a-zA-Z]+(\[[^\]]*\])?(\{{[^{{}}]*\}})?', ' ', 'g')"
    x = f"translate({x}, chr(8232) || chr(8233) || chr(10) || chr(13) || chr(9), '     ')"
    return sql_squeeze(rf"regexp_replace({x}, '\$[^$]{{10,}}\$', ' ', 'g')")


def sql_words(x: str) -> str:
    x = rf"regexp_replace(regexp_replace(lower({x}), '[^a-zA-Z\P{{L}}]', '0', 'g'), '[^0-9\P{{N}}]', '0', 'g')"
    return rf"regexp_extract_all({x}, '\b[a-zA-Z][a-zA-Z''-]*\b')"


def sql_sentences(x: str) -> str:
    return rf"list_filter(list_transform(string_split(regexp_replace(trim({x}), '([.!?])[\s\x0b]+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s)), lambda s: s <> '')"


_VERBS = "[" + ", ".join(f"'{v}'" for v in t.COMMON_VERBS) + "]"
_ONE_OF = lambda ps: "|".join(f"(?:{p})" for p in ps).replace("'", "''")
_STATS = rf"""
with c as (select doc_id, {sql_clean("text")} as t from documents),
w as (select *, {sql_words("t")} as words, length(t) as n, lower(trim(t)) as low from c),
s as (select *, n::bigint as clean_length, len(words)::bigint as word_count,
    length(regexp_replace(t, '\P{{L}}', '', 'g'))::bigint as alpha_chars,
    coalesce(length(regexp_replace(t, '\P{{L}}', '', 'g')) / nullif(n, 0)::double, 0) as alpha_ratio,
    coalesce(length(regexp_replace(t, '[\p{{L}}\p{{N}}\p{{Z}}\s\x0b\x1c-\x1f\x85]', '', 'g')) / nullif(n, 0)::double, 0) as punct_ratio,
    coalesce(len(list_distinct(words)) / nullif(len(words), 0)::double, 0) as lexical_diversity,
    (n - length(replace(t, '.', '')))::bigint as period_count,
    coalesce(length(regexp_replace(t, '[\p{{L}}\p{{N}}\p{{Z}}\s\x0b\x1c-\x1f\x85.,;:!?\-''"()]', '', 'g')) / nullif(n, 0)::double, 0) as symbol_ratio
  from w),
x as (select *, case
    when low in ({", ".join(f"'{p}'" for p in t.PLACEHOLDERS)}) then 'placeholder_abstract'
    when n < 100 then 'too_short_chars' when word_count < 20 then 'too_few_words' when alpha_chars < 30 then 'too_few_alphabetic_chars'
    when alpha_ratio <= 0.5 then 'low_alphabetic_ratio' when punct_ratio >= 0.3 then 'high_punctuation_ratio'
    when n > 5000 then 'too_long_chars_possible_full_text' when word_count > 3000 then 'too_long_words_possible_full_text'
    when lexical_diversity < 0.2 then 'low_lexical_diversity' when symbol_ratio > 0.15 then 'formula_or_symbol_heavy'
    when period_count = 0 then 'no_period'
    when not (list_has_any(words, {_VERBS}) or len(list_filter(words, lambda v: length(v) > 5 and regexp_matches(v, '(ed|ing|izes|ises)$'))) > 0) then 'no_verb_like_word'
    when regexp_matches(low, '{_ONE_OF(t.BOILERPLATE_PATTERNS)}') then 'publisher_boilerplate'
    when regexp_matches(low, '{_ONE_OF(t.REFERENCE_PATTERNS)}') then 'reference_like_content'
    when length(low) - length(translate(low, '<>', '')) >= 3 then 'remaining_markup_corruption'
    when len(regexp_extract_all(regexp_replace(regexp_replace(t, '[^a-zA-Z\P{{L}}]', '0', 'g'), '[^0-9\P{{N}}]', '0', 'g'), '\b[a-zA-Z]\b')) > 30 then 'many_single_letter_formula_fragments'
    else '' end as removal_reason from s)
"""
_FORM = rf"trim(regexp_replace(regexp_replace(lower(t), '[^a-z0-9\s\x0b]', ' ', 'g'), '[\s\x0b]+', ' ', 'g'))"


@query("clean_funnel", _STATS + "select removal_reason, count(*) as n from x group by removal_reason")
def clean_funnel(spark, folder):
    return cleaning.classify(table(spark, folder, "documents")).groupBy("removal_reason").agg(F.count(F.lit(1)).alias("n"))


@query("text_stats", _STATS + f"select doc_id, clean_length, word_count, alpha_chars, {r('alpha_ratio')} as alpha_ratio, {r('punct_ratio')} as punct_ratio, {r('lexical_diversity')} as lexical_diversity, period_count, {r('symbol_ratio')} as symbol_ratio from x")
def text_stats(spark, folder):
    return round_all(cleaning.classify(table(spark, folder, "documents")).select("doc_id", *t.text_stats(F.lit(""))))


@query("removal_reasons", _STATS + "select doc_id, removal_reason from x")
def removal_reasons(spark, folder):
    return cleaning.classify(table(spark, folder, "documents")).select("doc_id", "removal_reason")


@query("kept_abstracts", _STATS + "select doc_id, t as text, length(t)::bigint as abstract_length, md5(t) as abstract_md5_hash from x where removal_reason = ''")
def kept_abstracts(spark, folder):
    own = cleaning.passed(table(spark, folder, "documents"))
    return own.select("doc_id", F.col("clean_text").alias("text"), F.length("clean_text").cast("long").alias("abstract_length"), F.md5("clean_text").alias("abstract_md5_hash"))


@query("dup_normal_form_md5", _STATS + f"select doc_id, md5({_FORM}) as form from x")
def dup_normal_form_md5(spark, folder):
    return table(spark, folder, "documents").select("doc_id", F.md5(t.duplicate_form(t.clean_text(F.col("text")))).alias("form"))


@query("exact_dedup", _STATS + f", f as (select doc_id, {_FORM} as form from x where removal_reason = '') select doc_id from f qualify row_number() over (partition by form order by doc_id) > 1")
def exact_dedup(spark, folder):
    return cleaning.exact_duplicates(cleaning.passed(table(spark, folder, "documents")))


@query("near_dup")
def near_dup(spark, folder):
    passed = cleaning.passed(table(spark, folder, "documents"))
    return cleaning.near_duplicates(passed.join(cleaning.exact_duplicates(passed), "doc_id", "left_anti"))


@query("clean_corpus")
def clean_corpus(spark, folder):
    kept, removed = cleaning.clean(table(spark, folder, "documents"))
    counts = removed.groupBy("removal_reason").agg(F.count(F.lit(1)).alias("n"))
    return counts.unionByName(kept.select(F.lit("").alias("removal_reason")).groupBy("removal_reason").agg(F.count(F.lit(1)).alias("n")))


@query("html_strip_pages", f"select page_id, length(c)::bigint as n_chars, md5(c) as digest from (select page_id, {sql_clean('html')} as c from pages)")
def html_strip_pages(spark, folder):
    own = t.clean_text(F.col("html"), unescape=False)
    return table(spark, folder, "pages").select("page_id", own.alias("c")).select("page_id", F.length("c").cast("long").alias("n_chars"), F.md5("c").alias("digest"))


@query("sentence_split", f"select doc_id, len(s)::bigint as n_sentences, md5(array_to_string(s, '|')) as digest from (select doc_id, {sql_sentences('text')} as s from documents)")
def sentence_split(spark, folder):
    own = table(spark, folder, "documents").select("doc_id", t.sentences(F.col("text")).alias("s"))
    return own.select("doc_id", F.size("s").cast("long").alias("n_sentences"), F.md5(F.array_join("s", "|")).alias("digest"))


_PAPER = sql_squeeze(r"regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '([\p{L}\p{N}_])-\n([\p{L}\p{N}_])', '\1\2', 'g')")
_CHUNKS = f"""
with s as (select doc_id, {sql_sentences(_PAPER)} as s from documents),
c as (select doc_id, i::bigint as chunk, array_to_string(s[i * 20 + 1 : i * 20 + 20], ' ') as chunk_text from s, unnest(range(0, ((len(s) + 19) // 20)::bigint)) u(i)),
k as (select *, len(string_split({sql_squeeze("chunk_text")}, ' '))::bigint as chunk_words from c)
"""


@query("chunk_20", _CHUNKS + "select doc_id, chunk, chunk_words, md5(chunk_text) as digest from k where chunk_words >= 100")
def chunk_20(spark, folder):
    own = papers.sentence_chunks(table(spark, folder, "documents"), "text", ["doc_id"])
    return own.select("doc_id", F.col("chunk").cast("long").alias("chunk"), F.col("chunk_words").cast("long").alias("chunk_words"), F.md5("chunk_text").alias("digest"))


@query("sentence_subset", f"select doc_id, md5(array_to_string(case when len(s) <= 5 then s else list_transform(range(5), lambda i: s[floor(i * (len(s) / 5.0::double))::int + 1]) end, '|')) as digest from (select doc_id, {sql_sentences('text')} as s from documents)")
def sentence_subset(spark, folder):
    own = t.even_subset(t.sentences(F.col("text")), 5)
    return table(spark, folder, "documents").select("doc_id", F.md5(F.array_join(own, "|")).alias("digest"))


_SYL = "greatest(1, len(regexp_extract_all(v, '[aeiouy]+')) - case when regexp_matches(v, '[^aeiouyl]e$') and len(regexp_extract_all(v, '[aeiouy]+')) > 1 then 1 else 0 end)"
_EASY = "[" + ", ".join(f"'{w}'" for w in readability.EASY_WORDS) + "]"


def _sql_counts(x: str) -> str:
    return f"""len({sql_words(x)})::double as w, greatest(len({sql_sentences(x)}), 1)::double as s,
    coalesce(list_sum(list_transform({sql_words(x)}, lambda v: {_SYL})), 0)::double as y,
    length(regexp_replace(lower({x}), '[^a-z]', '', 'g'))::double as c,
    len(list_filter({sql_words(x)}, lambda v: {_SYL} >= 3))::double as p,
    len(list_filter({sql_words(x)}, lambda v: {_SYL} >= 2 and not list_contains({_EASY}, v)))::double as d"""


_GRADES = {
    "flesch_kincaid": "0.39 * w / s + 11.8 * y / nullif(w, 0) - 15.59",
    "flesch": "206.835 - 1.015 * w / s - 84.6 * y / nullif(w, 0)",
    "gunning_fog": "0.4 * (w / s + 100 * p / nullif(w, 0))",
    "coleman_liau": "0.0588 * (100 * c / nullif(w, 0)) - 0.296 * (100 * s / nullif(w, 0)) - 15.8",
    "dale_chall": "0.1579 * (100 * d / nullif(w, 0)) + 0.0496 * w / s + case when 100 * d / nullif(w, 0) > 5 then 3.6365 else 0 end",
    "ari": "4.71 * c / nullif(w, 0) + 0.5 * w / s - 21.43",
    "linsear_write": "case when w > 0 then case when ((w - p) + 3 * p) / s > 20 then ((w - p) + 3 * p) / s / 2 else (((w - p) + 3 * p) / s - 2) / 2 end end",
}


@query("readability_abstracts", f"with n as (select doc_id, case when trim(text) = '' then 'missing' when length(trim(text)) < 20 then 'too_short' else 'ok' end as status, {_sql_counts('text')} from documents) select doc_id, status as readability_status, " + ", ".join(f"case when status = 'ok' then {r(f'case when w > 0 then {e} end')} end as {m}_mean" for m, e in _GRADES.items()) + " from n")
def readability_abstracts(spark, folder):
    own = readability.score_texts(table(spark, folder, "documents").select("doc_id", "text"), "text")
    return round_all(own.drop("text"))


@query("readability_papers", _CHUNKS + f", n as (select doc_id, {_sql_counts('chunk_text')} from k where chunk_words >= 100), g as (select doc_id, " + ", ".join(f"({e}) as {m}" for m, e in _GRADES.items()) + " from n) select doc_id, count(*) as n_chunks, " + ", ".join([f"{r(f'avg({m})')} as {m}_mean, {r(f'case when count({m}) = 1 then 0 else stddev_samp({m}) end')} as {m}_std, " + ", ".join(f"{r(f'quantile_cont({m}, {p / 100})')} as {m}_p{p}" for p in (10, 25, 50, 75, 90)) for m in _GRADES]) + " from g group by doc_id")
def readability_papers(spark, folder):
    chunks = papers.sentence_chunks(table(spark, folder, "documents"), "text", ["doc_id"])
    return round_all(readability.aggregate_chunks(chunks, ["doc_id"]))


@query("line_normalise", f"""select doc_id, md5(regexp_replace(regexp_replace({sql_squeeze("replace(text, chr(173), '')")}, '([A-Za-z])- ([A-Za-z])', '\\1\\2', 'g'), '([A-Za-z])- ([A-Za-z])', '\\1\\2', 'g')) as digest from documents""")
def line_normalise(spark, folder):
    return table(spark, folder, "documents").select("doc_id", F.md5(t.normal_line(F.col("text"))).alias("digest"))


@query("paper_paragraphs")
def paper_paragraphs(spark, folder):
    own = table(spark, folder, "documents").select("doc_id", papers.paper_text(papers.lines_as_pages(F.col("text"))).alias("t"))
    return own.select("doc_id", F.size(F.split("t", "\n\n")).cast("long").alias("paragraphs"), F.md5("t").alias("digest"))


def swap_corrector():
    """A corrector for tests: some rewrites are edits, some only touch spacing, some are broken."""

    def model(sentences: list[str]) -> list[str]:
        out = []
        for x in sentences:
            k = len(x) % 5
            w = x.split(" ")
            out.append(x if k == 0 else " ".join([*w[:1], *w]) if k == 1 else x.replace(" ", "  ") if k == 2 else x[: len(x) // 2] if k == 3 else x.replace("the ", "a ", 1))
        return out

    return model


@query("grammar_edits")
def grammar_edits(spark, folder):
    return round_all(grammar.grammar_features(table(spark, folder, "documents").select("doc_id", "text"), swap_corrector))


def length_scorer():
    """A scorer for tests: a tenth of a nat for each character of the predicted tokens."""
    return lambda windows: [sum(len(x) for x in w[1:]) / 10 for w in windows]


_WINDOWS = f"""
with a as (select doc_id, list_filter(string_split({sql_squeeze("text")}, ' '), lambda v: v <> '') as w from documents),
b as (select doc_id, w[i * 64 + 1 : i * 64 + 64] as w from a, unnest(range(0, ((len(w) + 63) // 64)::bigint)) u(i)),
c as (select doc_id, count(*) as n_windows, sum(len(w) - 1)::bigint as n_pred_tokens, sum(list_sum(list_transform(w[2:], lambda v: length(v))) / 10.0) as nll from b where len(w) >= 2 group by doc_id)
"""


_PART = lambda test: f"(select doc_id, text from documents where doc_id % 5 {test} 0)"


@query("kneser_ney_perplexity", f"with {language_model.oracle_sql('documents', _PART('<>'))} select doc_id, n_tokens, n_pred_tokens, {r('neg_log_likelihood', 4)} as neg_log_likelihood, {r('perplexity', 4)} as perplexity, status from scored")
def kneser_ney_perplexity(spark, folder):
    """All documents under a model of four fifths of them, so that a fifth is unseen."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = language_model.fit(docs.where("doc_id % 5 <> 0"))
    out = round_all(language_model.perplexity(docs, model), 4)
    model.drop()  # the probabilities are written
    return out


@query("spelling_corrections")
def spelling_corrections(spark, folder):
    """Rare words of the documents that are one edit from a known word which stands between the same neighbours."""
    return round_all(spelling.corrections(table(spark, folder, "documents").select("doc_id", "text")))


@query("perplexity_windows", _WINDOWS + f"select a.doc_id, len(a.w)::bigint as n_tokens, coalesce(n_windows, 0)::bigint as n_windows, coalesce(n_pred_tokens, 0)::bigint as n_pred_tokens, {r('nll')} as neg_log_likelihood, {r('exp(nll / n_pred_tokens)')} as perplexity, case when len(a.w) < 1 then 'empty' when nll is null then 'too_short' else 'ok' end as status from a left join c using (doc_id)")
def perplexity_windows(spark, folder):
    own = judging.perplexity(table(spark, folder, "documents").select("doc_id", "text"), length_scorer, window=64)
    return round_all(own)


_RAW = """concat(case conv_id % 3 when 0 then '' when 1 then 'Here it is: ' else 'no json ' end, case when conv_id % 7 = 6 then 'nothing' else concat('{"native_like_score": "', (conv_id % 14 - 2)::varchar, '.7", "confidence": ', (conv_id % 5)::varchar, '.25, "verdict": ', (turn % 3)::varchar, ', "reasons": ["a ", "", "b', turn::varchar, '",],}') end)"""
_OBJ = r"""regexp_replace(nullif(regexp_extract(raw, '(?s)\{.*\}', 0), ''), ',(\s*[}\]])', '\1', 'g')"""


@query(
    "judge_parse",
    f"""with a as (select conv_id, turn, {_RAW} as raw from conversations), o as (select *, {_OBJ} as obj from a)
select conv_id, turn::bigint as turn, obj is not null as parsed,
  (case when obj is null then 5 else greatest(0, least(10, trunc(json_extract_string(obj, '$.native_like_score')::double))) end)::bigint as native_like_score,
  (case when obj is null then 0 else greatest(0, least(1, json_extract_string(obj, '$.confidence')::double)) end)::double as confidence,
  (case when obj is null then 0 else greatest(0, least(1, trunc(json_extract_string(obj, '$.verdict')::double))) end)::bigint as verdict,
  case when obj is null then concat('ERROR: failed to parse: ', substr(raw, 1, 80), '|(no reason given)|(no reason given)') else concat('a|b', turn::varchar, '|(no reason given)') end as reasons
from o""",
)
def judge_parse(spark, folder):
    own = table(spark, folder, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"))
    text = lambda c: c.cast("string")
    conv = F.col("conv_id")
    body = F.concat(F.lit('{"native_like_score": "'), text(conv % 14 - 2), F.lit('.7", "confidence": '), text(conv % 5), F.lit('.25, "verdict": '), text(F.col("turn") % 3), F.lit(', "reasons": ["a ", "", "b'), text(F.col("turn")), F.lit('",],}'))
    raw = F.concat(F.when(conv % 3 == 0, "").when(conv % 3 == 1, "Here it is: ").otherwise("no json "), F.when(conv % 7 == 6, "nothing").otherwise(body))
    out = judging.parse_answers(own.withColumn("raw", raw))
    return round_all(out.select("conv_id", "turn", "parsed", "native_like_score", "confidence", "verdict", F.array_join("reasons", "|").alias("reasons")))


@query("truncate_texts", "select doc_id, case when length(text) > 300 then concat(substr(text, 1, 300), chr(10), chr(10), '[TRUNCATED]') else text end as text from documents")
def truncate_texts(spark, folder):
    return table(spark, folder, "documents").select("doc_id", t.truncate(F.col("text"), 300).alias("text"))


@query("streamed_funnel", _STATS + "select removal_reason, count(*) as n from x group by removal_reason")
def streamed_funnel(spark, folder):
    """clean_funnel over a stream of the documents' files, worked off and read back."""
    import uuid

    from ..streaming.stages import classify_stream

    path, name = f"{folder}/documents.parquet", f"funnel_{uuid.uuid4().hex}"
    batch = spark.read.parquet(path)
    files = batch.select("_metadata.file_name").distinct().limit(2).collect()
    alone = [f[0] for f in files] == ["documents.parquet"]  # a file beside other tables, or a folder of files
    stream = spark.readStream.schema(batch.schema)
    source = stream.option("pathGlobFilter", "documents.parquet").parquet(folder) if alone else stream.parquet(path)
    counts = classify_stream(source).groupBy("removal_reason").agg(F.count(F.lit(1)).alias("n"))
    counts.writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start().awaitTermination()
    return spark.table(name)
