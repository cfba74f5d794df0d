import math
import random

import pytest
from pyspark.sql import functions as F

from textloom.functions import scalars as s
from textloom.functions import special
from textloom.operators import importance, models, prep, sampling, stats
from textloom.sources import readers, writers


def loop_allocation(caps, total):
    """Largest remainders on what is left of the capacities, as a loop."""
    out = {k: int(math.floor(c / sum(caps.values()) * total)) for k, c in caps.items()}
    while (left := total - sum(out.values())) > 0:
        rest = {k: caps[k] - out[k] for k in caps}
        raw = {k: rest[k] / sum(rest.values()) * left for k in caps}
        for k in sorted((k for k in caps if rest[k] > 0), key=lambda k: (-(raw[k] - math.floor(raw[k])), k))[:left]:
            out[k] += 1
    return out


@pytest.mark.parametrize("seed", range(4))
def test_allocation(spark, seed):
    r = random.Random(seed)
    caps = {f"s{i}": r.randrange(1, 40) for i in range(r.randrange(1, 12))}
    df = spark.createDataFrame(list(caps.items()), "stratum string, capacity long")
    for total in (0, 1, sum(caps.values()) // 2, sum(caps.values()) - 1, sum(caps.values())):
        got = {x.stratum: x.allocated for x in sampling.allocate(df, total).collect()}
        assert got == loop_allocation(caps, total)
    with pytest.raises(Exception, match="asked for more"):
        sampling.allocate(df, sum(caps.values()) + 1).collect()


def test_samples_don_t_depend_on_partitions(spark):
    df = spark.range(1000).selectExpr("id", "id % 7 as a", "id % 2 as doi")
    one = {r.id for r in sampling.balanced_sample(df, "doi", 100, ["a"], "id").collect()}
    two = {r.id for r in sampling.balanced_sample(df.repartition(9), "doi", 100, ["a"], "id").collect()}
    assert one == two and len(one) == 200
    parts = {r.split: r.n for r in sampling.split(df, "a", "id").groupBy("split").agg(F.count("*").alias("n")).collect()}
    assert parts == {"test": 200, "val": 200, "train": 600}


def test_scalars(spark):
    df = spark.createDataFrame([("7.9",), ("x",), (None,), ("NaN",), ("-3",), ("1e400",)], "x string")
    got = df.select(s.to_number(F.col("x")), s.to_flag(F.col("x")), s.clamp(F.col("x"), 0, 10, 5, whole=True)).collect()
    assert [tuple(r) for r in got[:3]] == [(7.9, 7, 7), (None, 0, 5), (None, 0, 5)] and got[3][0] is None and got[4][2] == 0 and got[5][0] is None
    nums = spark.createDataFrame([(v,) for v in (-1.0, -0.1, 0.0, 0.5, 4.0, 30.0, 1e9, None)], "c double")
    assert [r[0] for r in nums.select(prep.citation_bin(F.col("c"))).collect()] == [None, "0", "0", "1-4", "1-4", "13-30", "31+", None]
    assert [r[0] for r in nums.select(s.exceeds(F.col("c"), 4)).collect()] == [0, 0, 0, 0, 0, 1, 1, 0]
    assert s.find_column(df, ["y", "X"]) == "x" and s.existing(df, ["x", "z"]) == ["x"]
    assert [r[0] for r in spark.sql("select 1.0 a, 0.0 b").select(s.safe_ratio(F.col("a"), F.col("b")), s.safe_log(F.col("b"))).collect()] == [None]


def test_pool(spark):
    rows = [("2010", "3", " physics ", "1"), ("2004", "3", "Physics", "1"), ("2010", "x", "Physics", "1"), ("2010", "3", "Arts", "0"), ("2021", "0", "BIOLOGY", "0"), ("2010", "1", "Physics", "2")]
    df = spark.createDataFrame(rows, "YEAR string, CitationCount string, category1 string, Has_DOI string")
    got = [(r.year, r.citation_count, r.field, r.doi) for r in sampling.citation_pool(df).collect()]
    assert got == [(2010.0, 3.0, "Physics", 1.0), (2021.0, 0.0, "Biology", 0.0)]
    with pytest.raises(ValueError, match="missing columns"):
        sampling.citation_pool(df.drop("YEAR"))


def test_caps_and_edges(spark):
    flat = spark.createDataFrame([(0.0,), (5.0,), (5.0,), (5.0,), (5.0,)], "c double")
    assert sampling.iqr_cap(flat, "c") == 5.0
    with pytest.raises(ValueError):
        sampling.iqr_cap(flat.where("c = 0"), "c")
    assert sampling.quantile_edges(spark.range(101).selectExpr("double(id) c"), "c", 4) == [0, 25, 50, 75, 100]


def test_special_functions():
    assert special.normal_two_sided(1.959963984540054) == pytest.approx(0.05)
    assert special.student_two_sided(2.2281388519649385, 10) == pytest.approx(0.05)
    assert special.chi2_upper(3.841458820694124, 1) == pytest.approx(0.05) and special.chi2_upper(18.307038053275146, 10) == pytest.approx(0.05)
    assert special.beta_regularised(2, 3, 0.5) == pytest.approx(0.6875) and special.correlation_p(1.0, 5) == 0.0


def test_rank_tests(spark):
    r = random.Random(3)
    rows = [(r.choice([0, 1, None]), float(r.randrange(6)) if r.random() < 0.9 else None, r.random()) for _ in range(120)]
    df = spark.createDataFrame(rows, "g int, a double, b double")
    got = {x.feature: x for x in stats.mann_whitney(df, ["a", "b"], "g").collect()}
    for j, name in ((1, "a"), (2, "b")):
        x, y = ([v[j] for v in rows if v[0] == g and v[j] is not None] for g in (0, 1))
        u = sum((p > q) + 0.5 * (p == q) for p in x for q in y)
        assert got[name].u == pytest.approx(u) and got[name].rank_biserial == pytest.approx(2 * u / (len(x) * len(y)) - 1)
        assert 0 <= got[name].p_value <= 1
    rho = {x.feature: x for x in stats.spearman_tests(df, ["a"], "b").collect()}["a"]
    both = [(v[1], v[2]) for v in rows if v[1] is not None]
    rank = lambda vs: [sum(w < v for w in vs) + (sum(w == v for w in vs) + 1) / 2 for v in vs]
    p, q = rank([x for x, _ in both]), rank([y for _, y in both])
    mp, mq = sum(p) / len(p), sum(q) / len(q)
    want = sum((i - mp) * (j - mq) for i, j in zip(p, q)) / math.sqrt(sum((i - mp) ** 2 for i in p) * sum((j - mq) ** 2 for j in q))
    assert rho.rho == pytest.approx(want) and rho.n == len(both)


def test_auc_equals_the_evaluator(spark):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator

    r = random.Random(4)
    df = spark.createDataFrame([(float(r.random() < 0.4), round(r.random(), 1)) for _ in range(300)], "label double, score double")
    want = BinaryClassificationEvaluator(rawPredictionCol="score", numBins=0).evaluate(df)
    assert stats.roc_auc(df, "label", "score").first()[0] == pytest.approx(want)


def test_preparation(spark):
    df = spark.createDataFrame([("a", 1.0, None, "x"), ("b", None, 2.0, None), ("c", 3.0, 4.0, "y")], "id string, n double, m double, cat string")
    out = prep.impute_all(df, ["id"], readability=["m"])
    assert [tuple(r) for r in out.orderBy("id").collect()] == [("a", 1.0, 3.0, "x", 1), ("b", 2.0, 2.0, "Missing", 0), ("c", 3.0, 4.0, "y", 0)]
    hot = prep.one_hot(out, ["cat"])
    assert hot.columns == ["id", "n", "m", "abstract_readability_missing", "cat_x", "cat_y"]
    assert prep.targets_last(hot, ["n"]).columns[-1] == "n" and prep.move_after(hot, "id", "m").columns[:3] == ["n", "m", "id"]
    assert prep.unique_feature_names(["a b", "a_b", "c"]) == ["a_b", "a_b_1", "c"]
    flags = spark.sql("select named_struct('t', 'JournalArticle, Review') s").select(*[v.alias(k) for k, v in prep.publication_flags(F.col("s.t")).items()]).first()
    assert tuple(flags) == (1, 0, 1, 0)
    years = spark.sql("select 10 n_words, 0 n_sentences, 40 n_characters, 2020 year")
    row = prep.derived_features(years, 2026).first()
    assert row.words_per_sentence is None and row.chars_per_word == 4.0 and row.paper_age == 6


def test_models(spark):
    r = random.Random(5)
    rows = [(a, b, 1.0, float(a + 0.3 * r.gauss(0, 1) > 0)) for a, b in ((r.gauss(0, 1), r.gauss(0, 1)) for _ in range(300))]
    df = spark.createDataFrame(rows, "a double, b double, one double, y double").withColumn("twin", F.col("a") * 2)
    own = models.prepare(df, ["a", "b", "one", "twin"], correlation=0.95)
    assert own.columns == ["a", "b"]
    ready = own.apply(df, "y").select("features", "label")
    assert models.evaluate(models.probabilities(models.logistic(ready), ready))["roc_auc"] > 0.95
    table, test = models.glm_table(ready, own.columns)
    found = {x.feature: x for x in table.collect()}
    assert found["a"].direction == "positive" and found["a"].significant and test["p_value"] < 1e-6 and test["df"] == 2
    top = models.importances(models.boosted(ready, rounds=3, depth=2), own.columns).first()
    assert top.feature == "a" and top.splits > 0
    names = list(models.configurations({g: [g] for g in models.FEATURE_GROUPS} | {"linguistic_quality": models.LINGUISTIC}))
    assert names == [f"M{i}" for i in range(25)] and "M3" not in models.configurations({}, skip=["M3", "M10"])


def test_fusion_without_sources(spark):
    lists = importance.with_groups(importance.ranked_lists(spark, {"s": ["confidence", "ari_mean", "notes"]}))
    assert {r.feature: (r.main_group, r.linguistic_group) for r in lists.collect()} == {"confidence": ("Other", "Native-like language use"), "ari_mean": ("G. Linguistic quality", "Paper readability"), "notes": ("Other", None)}
    assert importance.max_pivot(lists, ["s", "t"]).where("main_group = 'A. Temporal'").first().mean_of_max == 0


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "in.csv").write_text('id,n,text\n0010,1,"a\nb ""q"""\n0020,NA,\n0030,2.5,nan\n')
    df = readers.read_csv(spark, f"file://{tmp_path}/in.csv", strings=["id"])
    assert [tuple(r) for r in df.collect()] == [("0010", 1.0, 'a\nb "q"'), ("0020", None, None), ("0030", 2.5, None)]
    assert readers.read_csv(spark, f"file://{tmp_path}/in.csv", columns=["id"], all_strings=True).columns == ["id"]
    writers.write_csv(df, f"file://{tmp_path}/out")
    assert readers.read_csv(spark, f"file://{tmp_path}/out", strings=["id"]).count() == 3
    for part in ("train", "test"):
        (tmp_path / "t" / part / "deep").mkdir(parents=True)
        (tmp_path / "t" / part / "deep" / f"{part}1.json.sections.txt").write_bytes(b"ok \xff" if part == "test" else "é".encode())
    got = [(r.paper_id, r.split, r.text) for r in readers.read_texts(spark, f"file://{tmp_path}/t", splits=["train", "test"]).collect()]
    assert sorted(got) == [("test1", "test", "ok �"), ("train1", "train", "é")]  # in no order
    (tmp_path / "list.txt").write_text("a\n\nb\nc\nd\n")
    assert [r.path for r in readers.read_list(spark, f"file://{tmp_path}/list.txt", 1, 3).collect()] == ["b", "c"]
    (tmp_path / "x.pdf").write_bytes(b"good")
    (tmp_path / "y.pdf").write_bytes(b"bad")
    parse = lambda raw: '{"pages": []}' if raw == b"good" else 1 / 0
    assert {r.paper_id: r.error is None for r in readers.read_pdfs(spark, f"file://{tmp_path}", parse).collect()} == {"x": True, "y": False}
    done = spark.createDataFrame([(1, False), (2, True)], "id long, failed boolean")
    assert {r.id for r in writers.pending(spark.range(4), done, "id", "failed").collect()} == {0, 2, 3}
    stage = lambda d: d.withColumn("failed", F.col("id") == 3)
    path = f"file://{tmp_path}/resumed"
    assert [writers.append_missing(spark.range(4), stage, path, "id", "failed") for _ in range(2)] == [4, 1]
