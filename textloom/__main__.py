"""Command lines: python -m textloom <command> --help. Tables are read and written as Parquet, or CSV by suffix."""

from __future__ import annotations

import argparse
import importlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as t
from .operators import cleaning, grammar, judging, papers, prep, readability, sampling, stats
from .sources import readers, writers


def load(spark: SparkSession, path: str, strings: list[str]) -> DataFrame:
    return readers.read_csv(spark, path, strings=strings) if path.endswith(".csv") else spark.read.parquet(path)


def save(df: DataFrame, path: str) -> None:
    if path.endswith(".csv"):
        writers.write_csv(df, path)
    elif path.endswith(".json"):
        writers.write_json(df, path)
    else:
        df.write.mode("overwrite").parquet(path)


def named(path: str):
    """module:function."""
    module, _, name = path.partition(":")
    return getattr(importlib.import_module(module), name)


def sharded(df: DataFrame, a) -> DataFrame:
    if a.shards > 1:
        df = sampling.shard(df, [a.id], a.shards, contiguous=False).where(F.col("shard") == a.shard).drop("shard")
    return df.orderBy(a.id).limit(a.limit) if a.limit else df


def run_clean(spark, a):
    kept, removed = cleaning.clean(load(spark, a.input, [a.id, a.text]), a.text, a.id)
    writers.write_audited(kept, removed, a.output)
    return writers.run_counts(removed, "removal_reason")


def run_json2txt(spark, a):
    if a.list:
        wanted = [r.path for r in readers.read_list(spark, a.list, a.start, a.end).collect()]
        own = spark.read.schema(papers.PAGES_SCHEMA).option("multiLine", True).json(wanted).select(readers.path_id(F.col("_metadata.file_path")).alias("paper_id"), "pages")
    else:
        own = readers.read_papers(spark, a.input, a.glob).select("paper_id", "pages")
    done = own.select("paper_id", papers.paper_text(F.col("pages")).alias("text"))
    if a.overwrite:
        save(done, a.output)
    else:
        writers.append_missing(own, lambda d: d.select("paper_id", papers.paper_text(F.col("pages")).alias("text")), a.output, "paper_id")
    return done.select(F.when(F.col("text") == "", "empty").otherwise("wrote").alias("status")).groupBy("status").count()


def run_pdf2json(spark, a):
    out = readers.read_pdfs(spark, a.input, named(a.parser))
    save(out, a.output)
    return writers.run_counts(out.withColumn("status", F.when(F.col("error").isNull(), "wrote").otherwise("failed")))


def run_readability_abstracts(spark, a):
    out = readability.score_texts(load(spark, a.input, [a.id, a.text]), a.text, "abstract_")
    save(out, a.output)
    return writers.run_counts(out, "abstract_readability_status")


def run_readability_papers(spark, a):
    texts = sharded(readers.read_texts(spark, a.input, splits=a.split).withColumnRenamed("paper_id", a.id), a)
    chunks = papers.sentence_chunks(texts, "text", [a.id], a.chunk_size)
    out = texts.select(a.id, "split", F.size(t.sentences(t.normal_paper(F.col("text")))).alias("n_sentences")).join(readability.aggregate_chunks(chunks, [a.id]), a.id, "left")
    save(out.withColumn("status", F.when(F.col("n_chunks").isNull(), "no_chunks").otherwise("ok")), a.output)
    return None


def run_perplexity(spark, a):
    if a.window > a.max_length:
        raise SystemExit("--window must not exceed --max-length")
    docs = load(spark, a.input, [a.id, a.text]).where(F.col(a.text).isNotNull())
    text = F.substring(F.col(a.text), 1, a.max_chars) if a.max_chars else F.col(a.text)
    out = judging.perplexity(sharded(docs.select(a.id, text.alias("text")), a), named(a.scorer), a.id, "text", a.window)
    save(out, a.output)
    return writers.run_counts(out)


def run_grammar(spark, a):
    docs = sharded(load(spark, a.input, [a.id, a.text]).select(a.id, a.text), a)
    save(grammar.grammar_features(docs, named(a.corrector), a.id, a.text, a.max_sentences, a.details), a.output)


def run_judge(spark, a):
    docs = sharded(load(spark, a.input, [a.id, a.text]).select(a.id, t.truncate(F.col(a.text), a.max_chars).alias("prompt")), a)
    stage = lambda d: judging.parse_answers(judging.ask(d, named(a.judge), calls=judging.Calls(a.retries, a.together, a.deadline or None, a.wait))).drop("prompt").withColumn("failed", judging.is_error(F.col("reasons")))
    writers.append_missing(docs, stage, a.output, a.id, "failed")


def run_sample(spark, a):
    save(sampling.balanced_sample(load(spark, a.input, [a.id]), a.by, a.per_class, a.strata, a.id, a.seed), a.output)


def run_prepare(spark, a):
    own = prep.coerce_numbers(load(spark, a.input, [a.id]), a.numbers)
    for c in a.fold:
        own = prep.fold_rare(own, c, a.least)
    own = prep.impute_all(prep.derived_features(own, a.year), [a.id])
    save(prep.targets_last(prep.one_hot(own, a.fold), a.targets), a.output)


def run_split(spark, a):
    out = sampling.split(load(spark, a.input, [a.id]), a.by, a.id, a.seed)
    writers.write_splits(out, a.output)
    return writers.run_counts(out, "split")


def run_summary(spark, a):
    own = load(spark, a.input, [a.id])
    save(stats.summary(own, a.numbers or [c for c, k in own.dtypes if k in ("double", "int", "bigint") and c != a.by], [a.by] if a.by else None), a.output)


def run_tests(spark, a):
    own = load(spark, a.input, [a.id])
    save(stats.mann_whitney(own, a.numbers, a.by), a.output)


_INT, _LIST = {"type": int}, {"nargs": "*", "default": []}
_SHARDS = {"limit": _INT | {"default": 0}, "shard": _INT | {"default": 0}, "shards": _INT | {"default": 1}}
COMMANDS = {
    "clean": (run_clean, {}),
    "json2txt": (run_json2txt, {"glob": {"default": "*.json"}, "list": {}, "start": _INT | {"default": 0}, "end": _INT | {"default": -1}, "overwrite": {"action": "store_true"}}),
    "pdf2json": (run_pdf2json, {"parser": {"required": True}}),
    "readability-abstracts": (run_readability_abstracts, {}),
    "readability-papers": (run_readability_papers, {"split": {"nargs": "*"}, "chunk-size": _INT | {"default": 20}} | _SHARDS),
    "perplexity": (run_perplexity, {"scorer": {"required": True}, "window": _INT | {"default": 256}, "max-length": _INT | {"default": 1024}, "max-chars": _INT | {"default": 0}} | _SHARDS),
    "grammar": (run_grammar, {"corrector": {"required": True}, "max-sentences": _INT | {"default": None}, "details": {"action": "store_true"}} | _SHARDS),
    "judge": (run_judge, {"judge": {"required": True}, "max-chars": _INT | {"default": 40000}, "retries": _INT | {"default": 2}, "together": _INT | {"default": 1}, "deadline": {"type": float, "default": 0.0}, "wait": {"type": float, "default": 0.0}} | _SHARDS),
    "sample": (run_sample, {"by": {"default": "doi"}, "per-class": _INT | {"default": 45000}, "strata": _LIST, "seed": _INT | {"default": 42}}),
    "prepare": (run_prepare, {"numbers": _LIST, "fold": _LIST, "least": _INT | {"default": 100}, "targets": _LIST, "year": _INT | {"required": True}}),
    "split": (run_split, {"by": {"required": True}, "seed": _INT | {"default": 42}}),
    "summary": (run_summary, {"numbers": _LIST, "by": {}}),
    "tests": (run_tests, {"numbers": _LIST, "by": {"required": True}}),
}


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="textloom")
    commands = parser.add_subparsers(dest="command", required=True)
    for name, (_, options) in COMMANDS.items():
        one = commands.add_parser(name)
        one.add_argument("--input", required=name != "json2txt")
        one.add_argument("--output", required=True)
        one.add_argument("--id", default="arxiv_id")
        one.add_argument("--text", default="abstract")
        for option, how in options.items():
            one.add_argument(f"--{option}", **how)
    a = parser.parse_args(args)
    spark = SparkSession.builder.appName(f"textloom {a.command}").getOrCreate()
    counts = COMMANDS[a.command][0](spark, a)
    if counts is not None:
        print(json.dumps({str(r[0]): r[1] for r in counts.collect()}))


if __name__ == "__main__":
    main()
