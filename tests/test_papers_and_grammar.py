import json
import re

import pytest
from pyspark.sql import functions as F

from textloom.functions import text as t
from textloom.operators import grammar, judging, papers, readability
from textloom.sources import readers


def paper(*boxes):
    return {"pages": [{"boxes": [{"boxclass": k, "textlines": [{"spans": [{"text": s} for s in line.split("|")]} for line in lines]} for k, lines in boxes]}]}


def text_of(spark, tmp_path, obj, name="p1.json"):
    (tmp_path / name).write_text(json.dumps(obj))
    return spark_rows(readers.read_papers(spark, f"file://{tmp_path}").select("paper_id", papers.paper_text(F.col("pages")).alias("t")))


def spark_rows(df):
    return {r[0]: r[1] for r in df.collect()}


def test_paper_text(spark, tmp_path):
    obj = paper(
        ("section-header", ["1 Intro"]),
        ("text", ["We recogni- tion of attrac-", "tive things and self-", "Made ones.", " ", "soft­hyphen | joined"]),
        ("figure", ["left out"]),
        ("text", ["ends with co-"]),
        ("section-header", ["operation"]),
        ("text", ["after", "5.1 References", "gone"]),
        ("text", ["gone too"]),
    )
    got = text_of(spark, tmp_path, obj)
    assert got == {"p1": "1 Intro\n\nWe recognition of attractive things and self- Made ones. softhyphen joined ends with co-\n\noperation\n\nafter"}


def test_papers_without_keys(spark, tmp_path):
    (tmp_path / "a.json").write_text("{}")
    (tmp_path / "b.json").write_text('{"pages": [{}, {"boxes": [{"boxclass": "text"}, {"boxclass": "text", "textlines": [{}, {"spans": [{}]}]}]}]}')
    assert text_of(spark, tmp_path, paper(("text", ["References"]), ("text", ["x"])), "c.json") == {"a": "", "b": "", "c": ""}


def test_sentences_chunks_and_subsets(spark):
    text = "One two. Three!  Four?\nFive 3.5 six. " + "Word " * 40 + "end. Last"
    df = spark.createDataFrame([(1, text)], "doc_id long, x string")
    got = df.select(t.sentences(F.col("x"))).first()[0]
    assert got == [s.strip() for s in re.split(r"(?<=[.!?])\s+", text.strip()) if s.strip()]
    assert df.select(t.even_subset(F.array(*map(F.lit, range(10))), 4)).first()[0] == [int(i * 2.5) for i in range(4)]
    assert df.select(t.windows(F.array(*map(F.lit, range(7))), 3)).first()[0] == [[0, 1, 2], [3, 4, 5]]
    assert papers.sentence_chunks(df, "x", ["doc_id"], 3, 1).count() == 2


def test_readability_formulas(spark):
    text = "The cat sat on the mat. The beautiful elephant remembered everything."
    df = spark.createDataFrame([(text,), ("short",), ("",), (None,)], "x string")
    rows = readability.score_texts(df, "x", "abstract_").collect()
    assert [r.abstract_readability_status for r in rows] == ["ok", "too_short", "missing", "missing"]
    w, s = 11, 2
    y = 6 + 1 + 3 + 3 + 3 + 4  # of the groups of vowels, less silent e
    assert rows[0].abstract_flesch_mean == pytest.approx(206.835 - 1.015 * w / s - 84.6 * y / w, abs=9)
    assert rows[0].abstract_ari_mean == pytest.approx(4.71 * len(re.sub("[^a-z]", "", text.lower())) / w + 0.5 * w / s - 21.43)
    assert rows[1].abstract_ari_mean is None


PAIRS = [
    ("The cat sat.", "The cat sat.", 0),
    ("The cat sat.", "", 0),
    ("The cat sat on it.", "The cat", 0),
    ("The cat sat.", "The cat sat and and and and sat.", 0),
    ("He go home now.", "He goes home now.", 1),
    ("It is sig-\nnificant here.", "It is significant here.", 0),
    ("As shown (Smith, 2017b) it works.", "As shown it works.", 0),
    ("The model was answering well.", "The model was solving well.", 0),
    ("A co-occurrence is seen .", "A cooccurrence is seen.", 0),
    ("They was late again.", "They were late again.", 1),
    ("We use 3 × 4 grids.", "We use 3 4 grids.", 0),
    ("It has learneded much.", "It has learned much.", 0),
    ("We go there because it rains.", "We go there because", 0),
    ("He have a dog.", "He has the dog.", 1),
]


def test_edits(spark):
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(PAIRS)], "i int, sentence string, corrected string")
    got = {r.i: r.edit for r in grammar.with_edits(df).collect()}
    assert [got[i] for i in range(len(PAIRS))] == [w for *_, w in PAIRS]


def test_grammar_features(spark):
    df = spark.createDataFrame([(1, "He go home. They is here."), (2, ""), (3, None)], "doc_id long, text string")
    fix = lambda: lambda xs: [x.replace("go ", "goes ").replace(" is ", " are ") for x in xs]
    got = {r.doc_id: r for r in grammar.grammar_features(df, fix, details=True).collect()}
    assert (got[1].sentences, got[1].grammar_edits, got[1].errors_per_sentence) == (2, 2, 1.0) and len(got[1].details) == 2
    assert (got[2].sentences, got[3].errors_per_sentence) == (0, 0.0)


def test_every_sentence_of_a_long_document_counts(spark):
    df = spark.createDataFrame([(1, "All is well now. " * 600 + "He go home. " * 7)], "doc_id long, text string")
    fix = lambda: lambda xs: [x.replace("go ", "goes ") for x in xs]
    got = grammar.grammar_features(df, fix).first()
    assert (got.sentences, got.grammar_edits) == (607, 7)
    assert grammar.grammar_features(df, fix, max_sentences=500).first().sentences == 500


ANSWERS = [
    ('{"native_like_score": 7, "confidence": 0.8, "verdict": 1, "reasons": ["a", " b ", ""]}', (True, 7, 0.8, 1, ["a", "b", "(no reason given)"])),
    ('Sure: {"native_like_score": "7.9", "confidence": 2, "verdict": 5, "reasons": "- one\\n* two\\n",}, done', (True, 7, 1.0, 1, ["one", "two", "(no reason given)"])),
    ("no json", (False, 5, 0.0, 0, None)),
    ("[1, 2]", (False, 5, 0.0, 0, None)),
    ('{"native_like_score": "x"}', (True, 5, 0.0, 0, ["(no reason given)"] * 3)),
    (None, (False, 5, 0.0, 0, None)),
    ('{"reasons": ["1","2","3","4","5","6","7","8","9"], }', (True, 5, 0.0, 0, list("12345678"))),
]


def test_answers(spark):
    df = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(ANSWERS)], "i int, raw string")
    for r in judging.parse_answers(df).collect():
        parsed, score, confidence, verdict, reasons = ANSWERS[r.i][1]
        assert (r.parsed, r.native_like_score, r.confidence, r.verdict) == (parsed, score, confidence, verdict), r
        if reasons is not None:
            assert r.reasons == reasons
        else:
            assert r.reasons[0].startswith("ERROR") and len(r.reasons) == 3
    errors = judging.parse_answers(df).select("i", judging.is_error(F.col("reasons")).alias("e")).collect()
    assert {r.i for r in errors if r.e} == {2, 3, 5}


def test_ask_retries_and_reports(spark):
    def judge():
        seen = {}

        def model(p):
            seen[p] = seen.get(p, 0) + 1
            if p == "never" or p == "second" and seen[p] < 2:
                raise RuntimeError("down")
            return "{}"

        return model

    df = spark.createDataFrame([("ok",), ("second",), ("never",)], "prompt string")
    got = {r.prompt: r.raw for r in judging.ask(df, judge).collect()}
    assert got == {"ok": "{}", "second": "{}", "never": "ERROR: down"}
    assert judging.token_budget(8192, 100, 256) == 8192 - 100 - 256 - 64 and judging.token_budget(100) == 64


def test_ask_in_batches(spark):
    class Model:
        def __call__(self, p):
            if p == "bad":
                raise RuntimeError("down")
            return f"one {p}"

        def batch(self, prompts):
            if "bad" in prompts:
                raise RuntimeError("all down")
            return [f"many {p}" for p in prompts]

    df = spark.createDataFrame([(f"p{i}",) for i in range(6)] + [("bad",), ("p7",)], "prompt string").coalesce(1)
    got = {r.prompt: r.raw for r in judging.ask(df, Model, retries=0, batch_size=3).collect()}
    assert got == {f"p{i}": f"many p{i}" for i in range(6)} | {"bad": "ERROR: down", "p7": "one p7"}


def test_models_see_rows_not_ids(spark):
    rows = [(1, "a b c d"), (1, "a b c"), (None, "x y"), (None, "x"), (2, ""), (3, None), (4, "q " * 1000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    scorer = lambda: lambda windows: [sum(len(x) for x in w[1:]) / 10 for w in windows]
    got = judging.perplexity(df, scorer, window=3)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan

    def brute(text):
        w = (text or "").split()
        cut = [x for i in range(0, len(w), 3) if len(x := w[i : i + 3]) > 1]
        return (None if text is None else len(w), len(cut), sum(len(x) - 1 for x in cut), round(sum(len(y) for x in cut for y in x[1:]) / 10, 6) if cut else None)

    keys = sorted(((r.doc_id, r.n_tokens, r.n_windows, r.n_pred_tokens, r.neg_log_likelihood and round(r.neg_log_likelihood, 6)) for r in got.collect()), key=str)
    assert keys == sorted(((i, *brute(x)) for i, x in rows), key=str)
    listed = judging.perplexity(df, scorer, window=3, tokens=lambda c: F.filter(F.split(c, " "), lambda x: x != ""))
    assert sorted(map(str, listed.collect())) == sorted(map(str, got.collect()))


def test_grammar_by_rows(spark):
    rows = [(1, "He go home."), (1, "They is here. It are so. All is well now."), (None, "We go. We go."), (5, "Fine."), (6, "go " * 300 + "end.")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    fix = lambda: lambda xs: [x.replace("go", "goes").replace("They is", "They are") for x in xs]
    found = grammar.grammar_features(df, fix, details=True)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    got = sorted(((r.doc_id, r.sentences, r.grammar_edits) for r in found.collect()), key=str)
    assert got == sorted([(1, 1, 1), (1, 3, 1), (None, 2, 2), (5, 1, 0), (6, 1, 0)], key=str)  # an answer of 128 words is too short for 301
    whole = grammar.grammar_features(df.where("doc_id = 6"), fix, max_tokens=400, max_new_tokens=400).first()
    assert (whole.sentences, whole.grammar_edits) == (1, 0)  # a word three times in a row is a broken answer
    assert grammar.grammar_features(df.limit(0), fix).count() == 0
