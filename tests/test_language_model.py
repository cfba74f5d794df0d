"""The Kneser-Ney model against plain Python, and its probabilities against what they have to add up to."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest

from textloom.operators import language_model as lm


def cut(text):
    return re.findall(r"[^ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


class Plain:
    def __init__(self, texts, d):
        self.d = d
        self.c3 = Counter()
        for t in texts:
            w = [lm.START, *cut(t)]
            self.c3.update(zip(w, w[1:], w[2:]))
        self.c2, self.c1 = Counter(), Counter()
        for u, v, w in self.c3:
            self.c2[v, w] += 1
        for v, w in self.c2:
            self.c1[w] += 1
        self.x3, self.x2 = defaultdict(list), defaultdict(list)
        for (u, v, w), n in self.c3.items():
            self.x3[u, v].append(n)
        for (v, w), n in self.c2.items():
            self.x2[v].append(n)

    def p(self, u, v, w):
        words, total = len(self.c1), sum(self.c1.values())
        p = 1 / (words + 1)
        if total:
            p = max(self.c1[w] - self.d, 0) / total + self.d * words / total * p
        for counts, key, own in ((self.x2, v, self.c2[v, w]), (self.x3, (u, v), self.c3[u, v, w])):
            if key in counts:
                t = sum(counts[key])
                p = max(own - self.d, 0) / t + self.d * len(counts[key]) / t * p
        return p


def corpus(seed, n):
    r = random.Random(seed)
    vocab = ["The", "the", "cat", "sat", "on", "mat", "É", "été", "x,", "y."]
    return [(i, "".join(r.choice(vocab) + r.choice([" ", "\n", "  ", "\t"]) for _ in range(r.choice([0, 1, 2, 5, 30])))) for i in range(n)]


def test_perplexities_of_a_plain_version(spark):
    train, held = corpus(1, 60), corpus(2, 40) + [(900, None), (901, ""), (902, "never seen words here"), (None, "the cat sat"), (903, "cat " * 3000)]
    schema = "doc_id long, text string"
    model = lm.fit(spark.createDataFrame(train, schema).repartition(3))
    plain = Plain([t for _, t in train], lm.DISCOUNT)
    got = {r.doc_id: r for r in lm.perplexity(spark.createDataFrame(held, schema).withColumnRenamed("x", "x").selectExpr("*", "1 as p", "'u' as u"), model).collect()}
    assert len(got) == len(held)
    for i, t in held:
        w = [lm.START, *cut(t)]
        nll = -sum(math.log(plain.p(*g)) for g in zip(w, w[1:], w[2:]))
        n = len(w) - 1
        assert (got[i].n_tokens, got[i].n_pred_tokens, got[i].status) == (n, max(0, n - 1), "empty" if n < 1 else "too_short" if n < 2 else "ok")
        if n > 1:
            assert got[i].neg_log_likelihood == pytest.approx(nll, rel=1e-9) and got[i].perplexity == pytest.approx(math.exp(nll / (n - 1)), rel=1e-9)
        else:
            assert got[i].perplexity is None
    model.drop()


def test_probabilities_add_up_to_one(spark):
    train = corpus(3, 40)
    model = lm.fit(spark.createDataFrame(train, "doc_id long, text string"), discount=0.6)
    vocab = [r.w for r in model.c1.collect()]
    contexts = [("the", "cat"), ("nowhere", "cat"), ("nowhere", "neither"), (lm.START, "the")]
    rows = [(u, v, w) for u, v in contexts for w in [*vocab, "an unknown word"]]
    sums = Counter()
    for r in lm.probabilities(spark.createDataFrame(rows, "u string, v string, w string"), model).collect():
        assert 0 < r.p < 1
        sums[r.u, r.v] += r.p
    assert {k: pytest.approx(1, abs=1e-9) for k in contexts} == sums


def test_empty_training_table(spark):
    df = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    row = lm.perplexity(df, lm.fit(df.limit(0))).first()
    assert row.perplexity == pytest.approx(1.0) and row.n_pred_tokens == 2
    assert lm.perplexity(df.limit(0), lm.fit(df)).count() == 0


def test_only_joins_on_grams(spark):
    df = spark.createDataFrame(corpus(4, 20), "doc_id long, text string")
    plan = lm.perplexity(df, lm.fit(df))._jdf.queryExecution().optimizedPlan().toString()
    assert "Cross" not in plan and "MapInArrow" not in plan


def test_long_texts_take_time_in_proportion(spark):
    """The trigrams of a text are cut in one step: four times the words took sixteen times as long when each trigram found the words anew."""
    text = " ".join(f"w{i % 5000}" for i in range(60_000))
    df = spark.createDataFrame([(1, text), (2, None), (3, " \n")], "doc_id long, text string")
    plan = lm.trigrams(df, keep=["doc_id"])._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "regexp_extract_all" not in plan
    got = lm.trigrams(df, keep=["doc_id"]).groupBy("doc_id").sum("m").collect()
    assert [tuple(r) for r in got] == [(1, 59_999)]
    first = lm.trigrams(df).where(f"u = '{lm.START}'").collect()
    assert [(r.v, r.w, r.m) for r in first] == [("w0", "w1", 1)]


def test_disk_is_given_back(spark, tmp_path):
    """No shuffle outlives the table written from it, and of the model and the joins' tables none is left when the query returns."""
    import os

    from textloom.plans import QUERIES
    from textloom.sources import staging

    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffles = lambda: {f for d in manager.localDirsString() for _, _, names in os.walk(d) for f in names if f.startswith("shuffle_") and f.endswith(".data")}
    before, option = shuffles(), spark.conf.get(staging.CLEANUP, None)
    staging.discard(staging.settle(spark.range(1000).selectExpr("id % 7 as k").groupBy("k").count(), "counts"))
    assert shuffles() - before == set() and spark.conf.get(staging.CLEANUP, None) == option
    spark.createDataFrame(corpus(5, 40), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    left = set(os.listdir(staging.shared_dir(spark).removeprefix("file:")))
    assert QUERIES["kneser_ney_perplexity"](spark, str(tmp_path)).count() == 40
    made = {f.rsplit("-", 1)[0] for f in os.listdir(staging.shared_dir(spark).removeprefix("file:")) if f not in left}
    assert made == {"scored-grams", "probabilities"}
