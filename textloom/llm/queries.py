"""The queries opN_<name>: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, fim, html_text, near_dup, phrases, quality, secret_scan, spans, toxicity, transport_stream, url_filter, warc
from .common import table

OP4_RULES = [
    url_filter.Rule("block", "net"),
    url_filter.Rule("allow", "example.net", "/en/"),
    url_filter.Rule("block", "example.com", "/de/"),
    url_filter.Rule("allow", "org", "/fr/"),
]


def op1_factorisation_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "quality"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages").select("page_id", "url", "html"), min_revisit_bytes=0)


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url", "html"), OP4_RULES)


def op5_secret_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), path=F.col("source"))
    return found.select("doc_id", "start_at", F.length("candidate").alias("n_chars"), F.sha2("candidate", 256).alias("candidate_sha256"), "score", "secret")


def op6_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))


def op7_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op9_minhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), width=4, percent=80)


def op10_transport_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return transport_stream.digests(docs)


def op11_text_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judge(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), table(spark, sf_dir, "labels").select("doc_id", "toxic"))


def op12_phrase_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents").select("lang", "text"), min_count=30, max_words=4, percent=80, top=2000)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digests(table(spark, sf_dir, "documents").select("doc_id", "text"), fim.Rule(seed=7, rate=100, spm_rate=50))


QUERIES = {
    "op1_factorisation_machine": op1_factorisation_machine,
    "op2_warc": op2_warc,
    "op3_html_text": op3_html_text,
    "op4_url_filter": op4_url_filter,
    "op5_secret_forest": op5_secret_forest,
    "op6_template_decontamination": op6_template_decontamination,
    "op7_sentence_spans": op7_sentence_spans,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_minhash_near_dup": op9_minhash_near_dup,
    "op10_transport_stream": op10_transport_stream,
    "op11_text_cnn": op11_text_cnn,
    "op12_phrase_sketches": op12_phrase_sketches,
    "op13_fill_in_middle": op13_fill_in_middle,
}
ORACLE_SQL = {
    "op2_warc": warc.oracle_sql(),
    "op4_url_filter": url_filter.oracle_sql(OP4_RULES),
    "op7_sentence_spans": spans.oracle_sql(),
    "op9_minhash_near_dup": near_dup.oracle_sql(width=4, percent=80),
    "op12_phrase_sketches": phrases.oracle_sql(),
    "op13_fill_in_middle": fim.oracle_sql(),
}
