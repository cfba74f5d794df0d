import hashlib

import pytest

pytest.importorskip("public_tokenizers")
pipeline = pytest.importorskip("corpus_pipeline")

from tests.llm.test_near_dup import brute  # noqa: E402
from textloom.llm import stages  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SECRET = "04dbebab91ab85687d33eeaaf9ac699e1188f962"


def prose(seed, n=60):
    import random

    r = random.Random(seed)
    return " ".join(" ".join(r.choice(["river", "stone", "walks", "under", "green", "quiet", "house", "morning", "letter", "garden", "seven"]) + r.choice("abcdefgh") for _ in range(9)).capitalize() + "." for _ in range(n // 9 + 1))


def junk(seed):
    return prose(seed).replace(" ", " | ").upper()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    rows = [(i, prose(i)) for i in range(60)] + [(100 + i, junk(i)) for i in range(25)]
    near = prose(3).split(" ")
    near[5] = "changed"
    item = "Which letter walks under the quiet garden while seven stones sleep in the house of the river until morning?"
    rows += [(200, prose(1)), (201, " ".join(near)), (202, prose(500) + " " + item + " " + prose(501)), (203, prose(600) + f' token = "{SECRET}" ' + prose(601)), (204, None), (205, ""), (4, prose(4)), (4, prose(4, 90)), (None, prose(700))]
    docs = [(i, t, "en", "src0", None if t is None else len(t)) for i, t in rows]
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1 if i < 100 else 0, 0) for i, _ in rows if i is not None and i < 200], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, docs


def test_run(spark, folder):
    path, docs = folder
    got = {r.doc_id: r for r in pipeline.run(spark, path).collect()}
    assert not {i for i in got if i is not None and 100 <= i < 200}  # junk
    assert 200 not in got and 201 not in got and 202 not in got
    assert set(range(60)) <= set(got) and None in got
    want = next(t for i, t, *_ in docs if i == 203).replace(SECRET, "[SECRET]")
    assert got[203].decoded_sha256 == hashlib.sha256(want.encode()).hexdigest() and got[203].n_chars == len(want)
    assert all(len(r.ids) == r.n_tokens for r in got.values())


def test_near_duplicates_stage_against_brute_force(spark, folder):
    path, docs = folder
    df = spark.createDataFrame(docs, SCHEMA)
    kept = stages.keep_one_of_near_duplicates(spark, df, path)
    assert kept.columns == df.columns
    single = [(i, t) for i, t, *_ in docs if i is not None and i != 4]
    want = {i for i, _, _, k in brute(single, 5) if k}
    rows = [r.doc_id for r in kept.collect()]
    assert set(rows) - {None, 4} == want and rows.count(4) == 1 and rows.count(None) == 1


def test_stages_return_the_columns_of_documents(spark, folder):
    path, docs = folder
    empty = spark.createDataFrame([], SCHEMA)
    for _, stage in pipeline.STAGES[:-1]:
        assert stage(spark, spark.createDataFrame(docs, SCHEMA), path).columns == empty.columns
        assert stage(spark, empty, path).count() == 0
        more = spark.createDataFrame(docs, SCHEMA).selectExpr("*", "1 as score", "'x' as path", "2 as node", "3 as predicted", "4 as place")
        assert stage(spark, more, path).columns == more.columns
    assert pipeline.STAGES[-1][1](spark, empty, path).count() == 0


def test_the_stages():
    assert [n for n, _ in pipeline.STAGES] == ["quality classifier", "near-duplicates", "benchmark decontamination", "secret scan", "byte-level BPE"]


def test_very_long_texts_and_repeated_rows(spark, folder):
    path, docs = folder
    long = " ".join(prose(9000 + i, 2000) for i in range(40)) + f' password = "{SECRET}" ' + prose(1)
    rows = [*docs[:30], *docs[:5], (900, long, "en", "src0", len(long)), (901, long, "en", "src0", len(long))]
    df = spark.createDataFrame(rows, SCHEMA)
    kept = df
    for _, stage in pipeline.STAGES[1:-1]:
        kept = stage(spark, kept, path)
    got = {r.doc_id: r.text for r in kept.collect()}
    assert set(got) == {r[0] for r in docs[:30]} | {900}
    assert got[900] == long.replace(SECRET, "[SECRET]")
    last = {r.doc_id: r for r in pipeline.STAGES[-1][1](spark, kept, path).collect()}
    assert last[900].decoded_sha256 == hashlib.sha256(got[900].encode()).hexdigest()
