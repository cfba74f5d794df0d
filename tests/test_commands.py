import json

from textloom.__main__ import main

GOOD = "We present a careful study of river stones and it shows how water moves them along the bed over many long seasons of rain. "


def scorer():
    return lambda windows: [float(len(w) - 1) for w in windows]


def corrector():
    return lambda xs: [x.replace("present", "presents") for x in xs]


def judge():
    return lambda prompt: '{"native_like_score": 9, "confidence": 1, "verdict": 1, "reasons": ["a", "b", "c"]}'


def test_commands(spark, tmp_path, capsys):
    base = f"file://{tmp_path}"
    rows = [(f"00{i}0", GOOD * (1 + i % 3) + f"Item {i}.", i % 2, i * 1.5, "abc"[i % 3]) for i in range(30)] + [("x", "short", 1, None, "a")]
    spark.createDataFrame(rows, "arxiv_id string, abstract string, doi int, n double, kind string").write.parquet(f"{base}/in")
    main(["clean", "--input", f"{base}/in", "--output", f"{base}/clean"])
    assert json.loads(capsys.readouterr().out)["too_short_chars"] == 1
    kept = spark.read.parquet(f"{base}/clean/kept")
    assert 0 < kept.count() < 31
    main(["readability-abstracts", "--input", f"{base}/in", "--output", f"{base}/read"])
    assert spark.read.parquet(f"{base}/read").where("abstract_flesch_mean is not null").count() == 30
    main(["perplexity", "--input", f"{base}/in", "--output", f"{base}/ppl", "--scorer", "tests.test_commands:scorer", "--shards", "2", "--shard", "1"])
    assert [r[0] for r in spark.read.parquet(f"{base}/ppl").where("status = 'ok'").selectExpr("round(perplexity - exp(1), 9)").distinct().collect()] == [0.0]
    main(["grammar", "--input", f"{base}/in", "--output", f"{base}/gram", "--corrector", "tests.test_commands:corrector", "--details"])
    assert spark.read.parquet(f"{base}/gram").count() == 31
    for _ in range(2):
        main(["judge", "--input", f"{base}/in", "--output", f"{base}/judged", "--judge", "tests.test_commands:judge"])
    assert spark.read.parquet(f"{base}/judged").count() == 31
    main(["sample", "--input", f"{base}/in", "--output", f"{base}/sample", "--per-class", "10", "--strata", "kind"])
    assert spark.read.parquet(f"{base}/sample").count() == 20
    main(["prepare", "--input", f"{base}/in", "--output", f"{base}/prep", "--numbers", "n", "--fold", "kind", "--least", "5", "--targets", "doi", "--year", "2026"])
    out = spark.read.parquet(f"{base}/prep")
    assert out.columns[-1] == "doi" and "kind_b" in out.columns and out.where("n is null").count() == 0
    main(["split", "--input", f"{base}/in", "--output", f"{base}/split", "--by", "kind"])
    assert spark.read.parquet(f"{base}/split").groupBy("split").count().count() == 3
    main(["summary", "--input", f"{base}/in", "--output", f"{base}/sum", "--numbers", "n", "--by", "kind"])
    main(["tests", "--input", f"{base}/in", "--output", f"{base}/tests.csv", "--numbers", "n", "--by", "doi"])
    assert spark.read.parquet(f"{base}/sum").count() == 3 and spark.read.option("header", True).csv(f"{base}/tests.csv").count() == 1


def test_papers(spark, tmp_path, capsys):
    (tmp_path / "p.json").write_text(json.dumps({"pages": [{"boxes": [{"boxclass": "text", "textlines": [{"spans": [{"text": "hello"}]}]}]}]}))
    main(["json2txt", "--input", f"file://{tmp_path}", "--output", f"file://{tmp_path}/out"])
    main(["json2txt", "--input", f"file://{tmp_path}", "--output", f"file://{tmp_path}/out"])
    assert [tuple(r) for r in spark.read.parquet(f"file://{tmp_path}/out").collect()] == [("p", "hello")]
