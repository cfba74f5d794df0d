"""Queries that have no SQL against plain versions on the same rows."""

import hashlib
import math
import os
import re
import unicodedata
from collections import Counter
from difflib import SequenceMatcher

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.operators import boosting, cleaning, grammar, models, prep, sampling, spelling, stats
from textloom.operators.ordering import quantiles
from textloom.plans import QUERIES
from textloom.plans import statistics as plans
from textloom.plans import texts

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def frame(sql):
    return duckdb.sql(sql.replace("FROM ", f"from '{FOLDER}/") if "FROM " in sql else sql).fetchnumpy()


def lines():
    return frame("select * FROM lineitem.parquet'")


def average_ranks(x):
    values, at, n = np.unique(x, return_inverse=True, return_counts=True)
    return (np.cumsum(n) - (n - 1) / 2)[at]


def test_mann_whitney(spark):
    own = lines()
    y = own["l_returnflag"] == "R"
    for r in QUERIES["mann_whitney_tests"](spark, FOLDER).collect():
        x = own[r.feature].astype(float)
        n0, n1 = int((~y).sum()), int(y.sum())
        u = average_ranks(x)[~y].sum() - n0 * (n0 + 1) / 2
        n = n0 + n1
        t = np.unique(x, return_counts=True)[1].astype(float)
        sd = math.sqrt(n0 * n1 / 12 * ((n + 1) - (t**3 - t).sum() / (n * (n - 1))))
        z = max(0.0, abs(u - n0 * n1 / 2) - 0.5) / sd
        assert (r.n0, r.n1, r.u) == (n0, n1, u) and abs(r.p_value - min(1.0, math.erfc(z / math.sqrt(2)))) < 2e-6
        assert abs(r.median1 - np.median(x[y])) < 1e-6 and abs(r.mean0 - x[~y].mean()) < 1e-5


def test_spearman(spark):
    own = lines()
    rows = QUERIES["spearman_tests"](spark, FOLDER).collect()
    assert [abs(r.rho) for r in rows] == sorted((abs(r.rho) for r in rows), reverse=True) and len(rows) == 3
    for r in rows:
        rho = np.corrcoef(average_ranks(own[r.feature]), average_ranks(own["l_extendedprice"]))[0, 1]
        df = r.n - 2
        t = abs(rho) * math.sqrt(df / (1 - rho * rho))
        x = np.linspace(0, min(t, 60), 200_001)
        density = np.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2) - 0.5 * math.log(df * math.pi) - (df + 1) / 2 * np.log1p(x * x / df))
        p = 1 - 2 * np.trapezoid(density, x)
        assert abs(r.rho - rho) < 1e-6 and abs(r.p_value - max(0.0, p)) < 3e-6


def matrix(spark, threshold=10):
    """Scaled features and labels of the training and validation rows, as the model queries make them."""
    own, train, val = plans._fitted(spark, FOLDER, threshold)
    out = []
    for d in (train, val):
        rows = d.collect()
        out += [np.array([r.features.toArray() for r in rows]), np.array([r.label for r in rows])]
    return own.columns, *out


def newton(x, y, weight, l2):
    """Logistic regression with an unpenalised constant in front."""
    full = np.column_stack([np.ones(len(x)), x])
    b = np.zeros(full.shape[1])
    ridge = l2 * np.diag([0.0] + [1.0] * x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-full @ b))
        h = full.T @ (full * (weight * p * (1 - p))[:, None]) + ridge
        step = np.linalg.solve(h, full.T @ (weight * (p - y)) + ridge @ b)
        b -= step
        if abs(step).max() < 1e-12:
            break
    return b, h


def auc(y, s):
    r = average_ranks(s)
    n1, n0 = y.sum(), (1 - y).sum()
    return (r[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * n0)


def balanced(y):
    return np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))


def test_glm(spark):
    columns, x, y, _, _ = matrix(spark)
    b, h = newton(x, y, np.ones(len(y)), 0.0)
    se = np.sqrt(np.diag(np.linalg.inv(h)))
    rows = {r.feature: r for r in QUERIES["glm"](spark, FOLDER).collect()}
    for k, name in enumerate(["const", *columns]):
        p = math.erfc(abs(b[k] / se[k]) / math.sqrt(2))
        assert abs(rows[name].coefficient - b[k]) < 1e-4 and abs(rows[name].p_value - p) < 1e-4
        assert abs(rows[name].odds_ratio / math.exp(b[k]) - 1) < 1e-3 and rows[name].significant == (rows[name].p_value < 0.05)


def test_logistic(spark):
    _, x, y, vx, vy = matrix(spark)
    b, _ = newton(x, y, balanced(y), 1.0)
    s = 1 / (1 + np.exp(-(b[0] + vx @ b[1:])))
    got = {r.metric: r.value for r in QUERIES["logistic"](spark, FOLDER).collect()}
    assert abs(got["roc_auc"] - auc(vy, s)) < 1e-3 and abs(got["accuracy"] - ((s >= 0.5) == (vy == 1)).mean()) < 5e-3


def test_boosted(spark):
    rows = QUERIES["gbt"](spark, FOLDER).collect()
    assert abs(sum(r.percent for r in rows) - 100) < 1e-3 and all(r.importance >= 0 and (r.splits > 0) == (r.importance > 0) for r in rows)
    assert [r.importance for r in rows] == sorted((r.importance for r in rows), reverse=True)
    assert rows[0].feature == "l_quantity"  # most of what the label is made of


def test_stop_on_auc(spark):
    own, train, val = plans._fitted(spark, FOLDER)
    val.persist()
    grow = {"rounds": 9, "depth": 3, "rate": 0.8, "subsample": 0.5}
    whole = models.boosted(train, **grow)
    stages = dict(models.staged_auc(whole, val, block=4))
    assert list(stages) == list(range(1, 10))
    rows = val.toPandas()
    margin = np.zeros(len(rows))
    for k, (tree, weight) in enumerate(zip(whole.trees, whole.treeWeights), 1):
        margin += weight * np.array([tree.predict(x) for x in rows["features"]])
        assert abs(stages[k] - auc(rows["label"].to_numpy(), margin)) < 1e-9
    for patience in (1, 50):
        best = 0
        for k in stages:  # the rule, step by step
            if best and k - best > patience:
                break
            if not best or stages[k] > stages[best]:
                best = k
        kept = models.best_by_auc(whole, val, patience)
        assert kept.getNumTrees == best
        assert abs(models.evaluate(models.probabilities(kept, val))["roc_auc"] - stages[best]) < 1e-9
    assert models.boosted(train, **grow, validation=val, stop="auc").getNumTrees == best
    assert models.importances(kept, own.columns).count() == len(own.columns)
    assert models.best_by_auc(whole, val.where("label = 1")).getNumTrees == 9
    assert models.best_by_auc(whole, val.limit(0)).getNumTrees == 9


def test_sweep(spark):
    rows = QUERIES["model_sweep"](spark, FOLDER).collect()
    assert {(r.model, r.threshold) for r in rows} == {(m, t) for m in ("logistic", "boosted") for t in (10, 20)}
    for t in (10, 20):
        train, val = plans.sample_rows(spark, FOLDER)
        train, val = (d.select(*plans.FEATURES, (F.col("count") > t).cast("int").alias("y")).toPandas().astype(float).to_numpy() for d in (train, val))
        x, y, vx, vy = train[:, :-1], train[:, -1], val[:, :-1], val[:, -1]
        m, s = x.mean(axis=0), x.std(axis=0)
        b, _ = newton((x - m) / s, y, balanced(y), 1.0)
        score = b[0] + (vx - m) / s @ b[1:]
        by = {r.model: r for r in rows if r.threshold == t}
        assert abs(by["logistic"].positive_rate - y.mean()) < 1e-6 and abs(by["logistic"].roc_auc - auc(vy, score)) < 2e-3
        assert by["boosted"].roc_auc > 0.8


def test_sweep_prepares_once(spark, monkeypatch):
    """The columns of a sweep are prepared and written once, whatever the number of thresholds; one without two classes is left out."""
    df = spark.range(400).selectExpr("id * 7 % 13 as a", "id % 5 as b", "id % 30 as count")
    calls = []
    for name in ("prepare", "settle"):
        monkeypatch.setattr(models, name, lambda *a, f=getattr(models, name), name=name, **k: calls.append((name, *a[1:2])) or f(*a, **k))
    got = models.sweep(df, df, ["a", "b"], "count", {"logistic": models.Logistic(5)}, [3, 10, 20, 90]).collect()
    assert sorted((r.threshold, r.positive_rate) for r in got) == [(t, pytest.approx(df.where(f"count > {t}").count() / 400)) for t in (3, 10, 20)]
    assert sum(c[0] == "prepare" for c in calls) == 1 and calls.count(("settle", "sweep")) == 2


def test_ablation(spark):
    rows = {r.config: r for r in QUERIES["ablation"](spark, FOLDER).collect()}
    base = rows["M0"]
    assert base.features == 5 and base.delta_roc_auc == 0
    for r in rows.values():
        assert abs(r.delta_roc_auc - (r.roc_auc - base.roc_auc)) < 2e-6 and abs(r.delta_accuracy - (r.accuracy - base.accuracy)) < 2e-6
    assert rows["M1"].features == 4 and rows["M8"].features == 1  # without and with the temporal group alone
    assert rows["M2"].roc_auc < base.roc_auc - 0.05  # without the quantity


def greedy(rows):
    """Ids that a greedy pass in id order drops, without any bound."""
    kept, dropped = [], set()
    for i, text in sorted(rows):
        form = re.sub(r"\s+", " ", re.sub(r"[^a-z0-9\s]", " ", text.lower())).strip()
        if any(k[:120] == form[:120] and SequenceMatcher(None, k, form).ratio() >= 0.95 for k in kept):
            dropped.add(i)
        else:
            kept.append(form)
    return dropped


def exact(rows):
    seen, dropped = set(), set()
    for i, text in sorted(rows):
        form = re.sub(r"\s+", " ", re.sub(r"[^a-z0-9\s]", " ", text.lower())).strip()
        dropped |= {i} if form in seen else set()
        seen.add(form)
    return dropped


def test_near_duplicates_and_clean_corpus(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    more = docs.where("length(text) between 200 and 4000").limit(30)
    edited = more.withColumn("doc_id", F.col("doc_id") + 10_000).withColumn("text", F.concat(F.expr("substring(text, 1, length(text) - 6)"), F.lit(" end.")))
    docs.unionByName(edited).unionByName(edited.withColumn("doc_id", F.col("doc_id") + 10_000)).write.parquet(f"{tmp_path}/documents.parquet")
    folder = str(tmp_path)
    rows = [(r.doc_id, r.clean_text) for r in cleaning.passed(spark.read.parquet(f"{folder}/documents.parquet")).collect()]
    same = exact(rows)
    near = greedy([r for r in rows if r[0] not in same])
    assert {r.doc_id for r in QUERIES["near_dup"](spark, folder).collect()} == near and len(near) > 5 and same
    counts = {r.removal_reason: r.n for r in QUERIES["clean_corpus"](spark, folder).collect()}
    assert counts.get(cleaning.EXACT) == len(same) and counts.get(cleaning.NEAR) == len(near) and counts[""] == len(rows) - len(same) - len(near)
    assert sum(counts.values()) == spark.read.parquet(f"{folder}/documents.parquet").count()


def test_near_duplicates_of_a_shared_prefix(spark):
    r = np.random.default_rng(5)
    start = "a shared beginning of every text that is longer than the prefix by which texts meet so that all of them meet in one group "
    words = [f"w{k}" for k in range(400)]
    rows = []
    for k in range(120):
        if rows and r.random() < 0.6:
            own = rows[r.integers(len(rows))][1].split(" ")
            own[-int(r.integers(1, 4))] = str(r.integers(9))
        else:
            own = (start + " ".join(r.choice(words, 60))).split(" ")
        rows.append((int(k * 37 % 120), " ".join(own)))
    df = spark.createDataFrame(rows + [(500, "alone"), (501, None)], "doc_id long, clean_text string")
    want = greedy(rows)
    assert 10 < len(want) < 100
    for batch in (7, 300):
        got = [x.doc_id for x in cleaning.near_duplicates(df, batch=batch).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def paper(text):
    squeeze = lambda x: re.sub(r"[\s\x1c-\x1f]+", " ", x).strip(" ")
    lines = [x.strip(" ") for x in text.split("\n")]
    lines = [re.sub(r"(?<=[A-Za-z])-\s+(?=[A-Za-z])", "", squeeze(x.replace("­", ""))) for x in lines if x]
    header = re.compile(r"\s*(?:(?:\d+(?:\.\d+)*)?\s*(?:references|bibliography|works\s+cited|literature\s+cited|reference\s+list))\s*", re.I | re.A)
    cut = next((i for i, x in enumerate(lines) if header.fullmatch(x.strip(" "))), len(lines))
    joined = []
    for x in lines[:cut]:
        if joined and re.search(r"(?<![\w])[A-Za-z]+-\s*$", joined[-1], re.A) and re.match("[a-z]", x):
            joined[-1] = re.sub(r"-\s*$", "", joined[-1]) + x
        else:
            joined.append(x)
    out, is_open = [], False
    for x in (y.strip(" ") for y in joined):
        if x and is_open:
            out[-1] += " " + x
        elif x:
            out.append(x)
        is_open = bool(x)
    return "\n\n".join(out)


def test_paragraphs(spark):
    want = {}
    for i, text in duckdb.sql(f"select doc_id, text from '{FOLDER}/documents.parquet'").fetchall():
        want[i] = paper(text)
    for r in QUERIES["paper_paragraphs"](spark, FOLDER).collect():
        assert (r.paragraphs, r.digest) == (len(want[r.doc_id].split("\n\n")), hashlib.md5(want[r.doc_id].encode()).hexdigest()), r.doc_id


def test_paragraphs_of_odd_lines(spark):
    r = np.random.default_rng(9)
    bits = ["one co-", "operation goes", "on-", "and Up", "", "x9-", "a9b-", "References", "  ", "ends -", "é-", "Two words- ", "b-", "\u00ad", "2 references"]
    rows = [(k, "\n".join(r.choice(bits, r.integers(0, 14), p=[0.12, 0.12, 0.12, 0.1, 0.05, 0.05, 0.05, 0.02, 0.05, 0.06, 0.06, 0.06, 0.06, 0.06, 0.02]))) for k in range(300)]
    rows += [(900, None), (901, ""), (902, "\n".join(["half of a bro-", "ken line that"] * 5000))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    from textloom.operators import papers

    got = {x.doc_id: x.t for x in df.select("doc_id", papers.paper_text(papers.lines_as_pages(F.col("text"))).alias("t")).collect()}
    assert got == {i: paper(x or "") for i, x in rows}


def broken(o, c):
    o, c = o.strip(), c.strip()
    ends = lambda x: x[-1:] in ".!?" and x
    return bool(not c or len(c) < 0.85 * len(o) or len(c) > 1.8 * len(o) or re.search(r"\b(\w+)( \1){2,}\b", c.lower()) or ends(o) and not ends(c) or re.search(rf"\b({'|'.join(grammar.CONNECTORS)})\s*$", c.lower()))


def squash(x):
    """A sentence without what the rules of the comparison pass over, each rule by itself and in plain words."""
    x = re.sub(r"(?<=\w)-\s*\n\s*(?=\w)", "", x)
    x = re.sub(r"(?<=\w)\s*\n\s*(?=\w)", " ", x)
    return unicodedata.normalize("NFKC", re.sub(r"(?<=[A-Za-z])-\s+(?=[A-Za-z])", "", x))


def essence(x):
    x = squash(x)
    for marks, one in (("“”", '"'), ("’‘", "'"), ("–—−", "-"), ("×", " x ")):
        for m in marks:
            x = x.replace(m, one)
    x = "".join(" " if c in "∗*†‡§¶" else c for c in x)
    x = "".join(c for c in x if ord(c) < 128)
    x = re.sub(r"(?i)\([^()]*\b\d{4}\s*[a-z]?(?:\s*,\s*[a-z])?[^()]*[)\];.,:]?", "", x)
    for pattern, new in grammar.SPACINGS:  # fixed values
        x = re.sub(pattern, new, x)
    for end in ("ing", "ed", "s"):
        x = re.sub(rf"\b(\w+?)({end})\2\b", r"\1\2", x)
    return x.lower()


def plainly_formal(a, b):
    """Whether two sentences differ in layout, citations, signs or one content word alone."""
    cited = lambda x: essence(re.sub(r"(?i)\([^()]*\b\d{4}\s*[a-z]?(?:\s*,\s*[a-z])?[^()]*[)\];.,:]?", "", squash(x)))
    blanked = lambda x: "".join(" " if c in "×−–—" else c for c in squash(x))
    tidy = lambda x: " ".join(re.split(r"\s+", x)).strip()
    if re.sub(r"[\s\-\[\](){}/'\"]+", "", essence(a)) == re.sub(r"[\s\-\[\](){}/'\"]+", "", essence(b)):
        return True
    if tidy(cited(a)) == tidy(cited(b)) or tidy(essence(blanked(a))) == tidy(essence(blanked(b))):
        return True
    old, new = (re.findall("[A-Za-z0-9]+", blanked(x)) for x in (a, b))
    other = [k for k in range(min(len(old), len(new))) if old[k] != new[k]]
    return len(old) == len(new) and len(other) == 1 and len(old[other[0]]) >= 4 and len(new[other[0]]) >= 4


@pytest.mark.parametrize(
    ("original", "corrected", "formal"),
    [
        ("We use a model-\nbased plan.", "We use a modelbased plan.", True), ("The cost is 5 km.", "The cost is 5km.", True), ("It works (Smith, 2019) well.", "It works well.", True),
        ("A “quoted” word.", 'A "quoted" word.', True), ("The range 3–5 holds.", "The range 3-5 holds.", True), ("It is good , and fast.", "It is good, and fast.", True), ("See Table∗ two.", "See Table two.", True),
        ("The quick fox runs.", "The rapid fox runs.", True), ("The fox is here.", "The fox are here.", False), ("He go home.", "He goes home.", False), ("The methods shows gains.", "The method shows gains.", True),
        ("They walkeded far.", "They walked far.", True), ("Results was shown in figure.", "The results were shown in the figure.", False), ("We has a plan.", "We have a plan.", False), ("One two three.", "One three two.", False),
    ],
)
def test_what_is_no_grammar(original, corrected, formal):
    assert grammar.same_but_for_form(original, corrected) == plainly_formal(original, corrected) == formal


def test_grammar_edits(spark):
    model = texts.swap_corrector()
    got = {r.doc_id: r for r in QUERIES["grammar_edits"](spark, FOLDER).collect()}
    total = 0
    for i, text in duckdb.sql(f"select doc_id, text from '{FOLDER}/documents.parquet'").fetchall():
        own = [s for x in re.split(r"(?<=[.!?])[ \t\n\x0b\f\r]+", text.strip(" ")) if (s := x.strip(" "))]
        own = own if len(own) <= 500 else [own[math.floor(k * (len(own) / 500))] for k in range(500)]
        short = lambda x, n: re.match(rf"\s*(?:\S+\s+){{0,{n - 1}}}\S*", x)[0].rstrip() if len(x.split()) > n else x
        pairs = [(s, short(c, 128)) for s, c in zip(own, model([short(s, 256) for s in own]))]
        edits = sum(not broken(s, c) and s != c and not plainly_formal(s, c) for s, c in pairs)
        total += edits
        assert (got[i].sentences, got[i].grammar_edits) == (len(own), edits), i
        assert abs(got[i].errors_per_sentence - edits / max(1, len(own))) < 1e-6
    assert total > 20


def test_spelling_corrections(spark):
    cut = lambda text: re.findall(r"[^\W\d_]+(?:['’][^\W\d_]+)*", (text or "").lower())
    texts_of = [(i, cut(t)) for i, t in duckdb.sql(f"select doc_id, text from '{FOLDER}/documents.parquet'").fetchall()]
    n = Counter(w for _, t in texts_of for w in t)
    k = Counter(p for _, t in texts_of for p in zip(t, t[1:]))
    letters = {c for w in n for c in w}

    def near(w):
        made = {w[:i] + w[i + 1 :] for i in range(len(w))} | {w[:i] + w[i + 1] + w[i] + w[i + 2 :] for i in range(len(w) - 1)}
        made |= {w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in letters} | {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in letters}
        return [c for c in made if c != w and n[c] >= spelling.KNOWN]

    found = {w: near(w) for w in n if n[w] < spelling.KNOWN and len(w) >= spelling.MIN_LETTERS}
    want = set()
    for i, t in texts_of:
        for at, w in enumerate(t):
            tried = [(-(k[t[at - 1], c] if at else 0) - (k[c, t[at + 1]] if at + 1 < len(t) else 0), -n[c], c) for c in found.get(w, ())]
            if tried and (min(tried)[0] < 0 or -min(tried)[1] >= spelling.SURE * n[w]):
                context, m, c = min(tried)
                want.add((i, at, w, c, -context, -m))
    got = QUERIES["spelling_corrections"](spark, FOLDER).select("doc_id", "place", "word", "correction", "context", "m").collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want) > 50


def test_quantiles(spark):
    r = np.random.default_rng(3)
    rows = [(None if k % 7 == 0 else f"g{k % 3}", float(v)) for k, v in enumerate(r.integers(0, 40, 500))] + [("one", 5.0), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    probs = [0.0, 0.1, 0.25, 1 / 3, 0.5, 0.95, 1.0]
    got = {x.g: list(x[1:]) for x in quantiles(df, "v", probs, ["g"]).collect()}
    assert set(got) == {None, "g0", "g1", "g2", "one"}
    for g, found in got.items():
        assert np.allclose(found, np.quantile([v for k, v in rows if k == g], probs))
    assert np.allclose(quantiles(df, "v", probs).first(), np.quantile([v for _, v in rows if v is not None], probs))
    assert quantiles(df.where("v > 99"), "v", [0.5]).count() == 0
    assert prep.medians(df.withColumn("w", F.lit(None).cast("double")), ["v", "w"]) == {"v": float(np.median([v for _, v in rows if v is not None]))}
    plan = stats.summary(df, ["v"])._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile" not in plan


def test_splits_of_hot_strata(spark):
    df = spark.range(1000).select("id", F.when(F.col("id") % 50 == 0, "rare").when(F.col("id") % 49 == 0, None).otherwise("hot").alias("y"), F.lit(7).alias("x"))
    done = sampling.split(df, "y", "id")
    plan = done._jdf.queryExecution().executedPlan().toString()
    assert all("__part" in line for line in plan.splitlines() if "Window [" in line and "__one" in line) and done.columns == ["id", "y", "x", "split"]
    counts = {(r.y, r.split): r["count"] for r in done.groupBy("y", "split").count().collect()}
    assert sum(n for (_, s), n in counts.items() if s == "test") == 200 and sum(n for (_, s), n in counts.items() if s == "val") == 200
    assert counts["rare", "test"] == 4 and sum(counts.values()) == 1000
    order = lambda i: (hashlib.md5(f"{i}42".encode()).hexdigest(), i)
    hot = sorted((r.id for r in done.where("y = 'hot'").collect()), key=order)
    assert {r.id for r in done.where("y = 'hot' and split = 'test'").collect()} == set(hot[: counts["hot", "test"]])
    twice = sampling.split(df.unionByName(df), "y", "id")
    assert twice.groupBy("id").agg(F.count_distinct("split").alias("n")).where("n > 1").count() == 0


def test_append_missing_asks_the_path(spark, tmp_path):
    from textloom.sources.writers import append_missing

    df = spark.range(5).withColumnRenamed("id", "key")
    path = f"{tmp_path}/out"
    assert append_missing(df, lambda d: d, path, "key") == 5 and append_missing(df, lambda d: d, path, "key") == 0
    with pytest.raises(Exception, match="wrong"):
        append_missing(df.withColumnRenamed("key", "wrong"), lambda d: d, path, "wrong")


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace as N

    from textloom.sources.staging import shared_dir

    at = lambda found, master: N(conf=N(get=lambda *_: found), sparkContext=N(master=master, applicationId="x"))
    assert shared_dir(at("hdfs:/a/", "yarn")) == "hdfs:/a"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(at(None, "spark://host:7077"))


def plain_boosting(bins, y, w, base, p, columns_of, drawn):
    """Best-first trees on given bins in numpy: the margins, and each feature's gain and splits."""
    margin, gain_of, split_of = np.full(len(y), base), np.zeros(bins.shape[1]), np.zeros(bins.shape[1], int)
    score = lambda g, h: g * g / np.maximum(h + p.l2, 1e-300)

    def best(rows, g, h, columns, depth):
        if p.depth and depth >= p.depth or not len(rows):
            return None
        found = None
        for f in columns:
            b = bins[rows, f]
            sums = [np.bincount(b, weights=v, minlength=256) for v in (g[rows], h[rows], np.ones(len(rows)))]
            for side in (False, True):
                if side and not sums[2][0]:
                    continue
                left = [np.cumsum(s[1:])[:-1] + (s[0] if side else 0) for s in sums]
                right = [s.sum() - x for s, x in zip(sums, left)]
                gain = (score(left[0], left[1]) + score(right[0], right[1]) - score(sums[0].sum(), sums[1].sum())) / 2
                ok = (np.minimum(left[2], right[2]) >= max(1, p.min_rows)) & (np.minimum(left[1], right[1]) >= p.min_hessian) & (sums[2][1:-1] > 0)
                gain = np.where(ok, gain, -np.inf)
                k = int(gain.argmax())
                if gain[k] > p.min_gain and (found is None or gain[k] > found[0] * (1 + 1e-9)):
                    found = (float(gain[k]), f, np.where(b == 0, side, b <= k + 1))
        return found

    for t in range(p.rounds):
        chance = 1 / (1 + np.exp(-margin))
        g, h = w * (chance - y), w * chance * (1 - chance)
        take, columns = drawn(t), columns_of(t)
        used = [(np.flatnonzero(take), np.arange(len(y)), 0)]
        leaves = [(*used[0], best(used[0][0], g, h, columns, 0))]
        while not p.leaves or len(leaves) < p.leaves:
            k = max((i for i, x in enumerate(leaves) if x[3]), key=lambda i: leaves[i][3][0], default=None)
            if k is None:
                break
            rows, every, depth, (gain, f, _) = leaves.pop(k)
            gain_of[f] += gain
            split_of[f] += 1
            again = best(rows, g, h, [f], 0)  # the same cut, to be laid on all rows
            b = bins[rows, f]
            cut = b[again[2] & (b > 0)].max(initial=0)
            side = bool(again[2][b == 0].any())
            left = np.where(bins[:, f] == 0, side, bins[:, f] <= cut)
            for m in (left, ~left):
                own, whole = rows[m[rows]], every[m[every]]
                leaves.append((own, whole, depth + 1, best(own, g, h, columns, depth + 1)))
        for rows, every, _, _ in leaves:
            margin[every] -= p.rate * g[rows].sum() / max(h[rows].sum() + p.l2, 1e-300)
    return margin, gain_of, split_of


@pytest.mark.parametrize("name", ["leaf_wise_boosting", "second_order_boosting"])
def test_boosting_queries(spark, name):
    p = {"leaf_wise_boosting": plans.LEAF_WISE, "second_order_boosting": plans.SECOND_ORDER}[name]
    got = (QUERIES["leaf_wise_boosting"] if name == "leaf_wise_boosting" else QUERIES["second_order_boosting"])(spark, FOLDER).collect()
    train, val = plans.gappy(spark, FOLDER)
    edges = boosting.find_edges(train, plans.FEATURES)
    rows = [d.select(*[F.col(c).cast("double").alias(f"f{i}") for i, c in enumerate(plans.FEATURES)], F.col("y").cast("double").alias("y")).withColumn("key", F.xxhash64("y", *[f"f{i}" for i in range(len(plans.FEATURES))])).toPandas() for d in (train, val)]
    both = [boosting.quantise(d[[f"f{i}" for i in range(len(plans.FEATURES))]].to_numpy(float), edges) for d in rows]
    y, n = rows[0]["y"].to_numpy(), len(rows[0])
    pos = y.sum()
    pair = {"balanced": (n / (2 * (n - pos)), n / (2 * pos)), "positive": (1.0, (n - pos) / pos)}[p.weights]
    w = np.where(y == 1, pair[1], pair[0])
    base = math.log(pair[1] * pos / (pair[0] * (n - pos)))
    columns_of = lambda t: sorted(np.random.default_rng([p.seed, t]).permutation(len(plans.FEATURES))[: max(1, round(p.columns * len(plans.FEATURES)))].tolist())
    drawn = lambda t: boosting._drawn(rows[0]["key"].to_numpy(), t, p)
    trees = got[0].trees
    margin, gain, splits = plain_boosting(both[0], y, w, base, boosting.replace(p, rounds=trees), columns_of, drawn)
    assert {r.feature: r.splits for r in got} == dict(zip(plans.FEATURES, splits.tolist()))
    assert {r.feature: r.gain for r in got} == {c: pytest.approx(g, rel=1e-5, abs=1e-4) for c, g in zip(plans.FEATURES, gain)}
    assert [r.gain for r in got] == sorted((r.gain for r in got), reverse=True) and sum(r.percent for r in got) == pytest.approx(100, abs=1e-3)
    model = boosting.fit(train, plans.FEATURES, "y", boosting.replace(p, rounds=trees))
    scores = boosting.predict(model, train).select("score").toPandas()["score"].to_numpy()
    assert np.sort(scores) == pytest.approx(np.sort(1 / (1 + np.exp(-margin))), abs=1e-7)
    assert 0.7 < got[0].validation_auc < 1
