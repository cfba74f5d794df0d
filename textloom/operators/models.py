"""Binary classifiers on Spark ML, inference tables, threshold sweeps and ablations."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import special
from ..functions.scalars import existing, exceeds
from ..sources.staging import discard, settle
from . import prep, stats

THRESHOLDS = [0, 1, 5, 10, 20, 50, 100]

# The feature groups of the ablations.
READABILITY = ["flesch_kincaid", "flesch", "gunning_fog", "coleman_liau", "dale_chall", "ari", "linsear_write"]
FEATURE_GROUPS = {
    "temporal": ["year", "paper_age"],
    "text_structure": ["n_characters", "n_words", "n_sentences", "words_per_sentence", "chars_per_word", "title_length", "abstract_length"],
    "publication_metadata": ["is_journal_article", "is_conference", "is_review", "is_book", "has_MAG", "is_ACL", "is_PubMedCentral"],
    "reference_count": ["reference_count"],
    "research_field": [],
    "author_impact": ["first_author_hindex", "max_author_hindex", "mean_author_hindex", "last_author_hindex", "num_authors", "mean_author_paper_count", "mean_author_citation_count"],
    "paper_readability": [f"{m}_mean" for m in READABILITY],
    "abstract_readability": [*(f"abstract_{m}_mean" for m in READABILITY), "abstract_readability_missing"],
    "perplexity": ["abstract_perplexity", "abstract_log_perplexity"],
    "grammar": ["grammar_edits", "grammar_error_rate"],
    "nativeness": ["native_like_score", "confidence", "verdict"],
}
GROUP_PREFIXES = {"publication_metadata": "publication_source", "research_field": "primary_category"}
LINGUISTIC = ["paper_readability", "abstract_readability", "perplexity", "grammar", "nativeness"]


def group_columns(df: DataFrame, groups: dict[str, list[str]] | None = None, prefixes: dict[str, str] | None = None) -> dict[str, list[str]]:
    """The columns of each group that df has, and linguistic_quality, the union of five groups."""
    prefixes = GROUP_PREFIXES if prefixes is None else prefixes
    out = {g: existing(df, cols) + [c for c in df.columns if g in prefixes and c.startswith(prefixes[g])] for g, cols in (groups or FEATURE_GROUPS).items()}
    out["linguistic_quality"] = [c for g in LINGUISTIC for c in out.get(g, [])]
    return out


def configurations(groups: dict[str, list[str]], skip: Iterable[str] = ()) -> dict[str, list[str]]:
    """M0 all features; M1 to M7 without a main group, M8 to M14 with it alone; M15 to M19 without a linguistic one, M20 to M24 with it alone."""
    main = ["temporal", "text_structure", "publication_metadata", "reference_count", "research_field", "author_impact", "linguistic_quality"]
    every = list(dict.fromkeys(c for g, cols in groups.items() for c in cols))
    out = {"M0": every}
    n = 1
    for names, alone in ((main, False), (main, True), (LINGUISTIC, False), (LINGUISTIC, True)):
        for g in names:
            own = set(groups.get(g, []))
            out[f"M{n}"] = [c for c in every if (c in own) == alone]
            n += 1
    return {k: v for k, v in out.items() if k not in set(skip)}


@dataclass
class Prepared:
    """Numbers fitted on the training rows, and the columns that are left."""

    columns: list[str]
    medians: dict[str, float]
    scales: dict[str, tuple[float, float]] = field(default_factory=dict)

    def apply(self, df: DataFrame, label: str) -> DataFrame:
        from pyspark.ml.feature import VectorAssembler

        out = prep.scale(prep.impute(df, self.medians), self.scales)
        out = out.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in self.columns})
        return VectorAssembler(inputCols=self.columns, outputCol="features").transform(out.withColumn("label", F.col(label).cast("double")))


def prepare(train: DataFrame, columns: list[str], scale_all: bool = False, drop_constant: bool = True, correlation: float | None = None) -> Prepared:
    """Medians, and scales of the columns with more than two values (or of all), from the training rows."""
    medians = prep.medians(train, columns)
    filled = prep.impute(train, medians)
    own = [c for c in columns if c in medians]
    if drop_constant:
        gone = set(prep.constant_columns(filled, own))
        own = [c for c in own if c not in gone]
    if correlation is not None:
        high = set(prep.highly_correlated(filled, own, correlation))
        own = [c for c in own if c not in high]
    wide = own if scale_all else prep.continuous_columns(filled, own)
    return Prepared(own, {c: medians[c] for c in own}, prep.scaling(filled, wide))


def balanced_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Adds weight n / (2 n_c)."""
    n, pos = df.agg(F.count(F.lit(1)), F.count_if(F.col(label) == 1)).first()
    pair = [n / (2 * x) if x else 0.0 for x in (n - pos, pos)]
    return df.withColumn("weight", F.when(F.col(label) == 1, pair[1]).otherwise(pair[0]))


@dataclass
class Logit:
    """A logistic model of the column `features`."""

    intercept: float
    coefficients: list[float]

    def chance(self, x: list[Column]) -> Column:
        return 1 / (1 + F.exp(-sum((F.lit(float(b)) * c for b, c in zip(self.coefficients, x)), F.lit(float(self.intercept)))))

    def transform(self, df: DataFrame) -> DataFrame:
        from pyspark.ml.functions import array_to_vector, vector_to_array

        p = self.chance([F.element_at("__x", i + 1) for i in range(len(self.coefficients))])
        out = df.withColumn("__x", vector_to_array("features")).withColumn("__p", p)
        return out.withColumn("probability", array_to_vector(F.array(1 - F.col("__p"), F.col("__p")))).drop("__x", "__p")


@dataclass(frozen=True)
class Logistic:
    """L2 logistic regressions with C = 1 and balanced classes, by Newton's method: a pass over the rows sums loss, gradient and Hessian of
    each model in numpy within tasks, and a few numbers for each reach the driver. A step that doesn't lower the loss is halved.
    """

    max_iter: int = 2000

    def __call__(self, train: DataFrame) -> Logit:
        from pyspark.ml.functions import vector_to_array

        rows = settle(train.select(vector_to_array("features").alias("x"), "label"), "logistic")
        size = rows.select(F.max(F.size("x"))).first()[0] or 0
        out = self.together(rows, [list(range(size))])[0]
        discard(rows)
        return out

    def together(self, rows: DataFrame, subsets: list[list[int]]) -> list[Logit]:
        """A model of each subset of the numbers in x of rows(x, label)."""
        n, pos = rows.agg(F.count(F.lit(1)), F.count_if(F.col("label") == 1)).first()
        if not pos or pos == n:
            return [Logit(30.0 if pos else -30.0, [0.0] * len(c)) for c in subsets]
        weight = (n / (2 * (n - pos)), n / (2 * pos))
        at = [np.zeros(len(c) + 1) for c in subsets]  # what is tried next
        known: list[tuple | None] = [None] * len(subsets)  # loss, place and step from there
        live = set(range(len(subsets)))
        for _ in range(self.max_iter):
            for k, (loss, g, h) in _sums(rows, {k: (subsets[k], at[k]) for k in live}, weight).items():
                own = np.append(0.0, at[k][1:])
                loss, g, h = loss + own @ own / 2, g + own, h + np.diag(np.append(1e-9, np.ones(len(own) - 1)))
                if known[k] is not None and loss > known[k][0] * (1 + 1e-12):
                    known[k] = (known[k][0], known[k][1], known[k][2] / 2)
                    if np.abs(known[k][2]).max() < 1e-9:
                        live.discard(k)
                else:
                    step = -np.linalg.solve(h, g)
                    known[k] = (loss, at[k], step)
                    if -(g @ step) < 1e-10 * n:
                        live.discard(k)
                at[k] = known[k][1] + known[k][2]
            if not live:
                break
        return [Logit(float(b[0]), b[1:].tolist()) for b in at]


def _sums(rows: DataFrame, wanted: dict[int, tuple[list[int], np.ndarray]], weight: tuple[float, float]) -> dict[int, tuple]:
    """Of each wanted model the sums over all rows: loss, its gradient and Hessian."""

    def run(batches):
        sums = {k: np.zeros(1 + len(b) + len(b) ** 2) for k, (_, b) in wanted.items()}
        for batch in batches:
            y = batch.column("label").to_numpy(zero_copy_only=False)
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(len(y), -1)
            x, w = np.column_stack([np.ones(len(y)), x]), np.where(y == 1, weight[1], weight[0])
            for k, (columns, b) in wanted.items():
                own = x[:, [0, *(c + 1 for c in columns)]]
                z = own @ b
                p = 1 / (1 + np.exp(-np.clip(z, -700, 700)))
                made = (w @ (np.logaddexp(0, z) - y * z), own.T @ (w * (p - y)), (own.T * (w * p * (1 - p))) @ own)
                sums[k] += np.concatenate([np.atleast_1d(m).ravel() for m in made])
        for k, v in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), k, np.int32)), pa.array(np.arange(len(v), dtype=np.int32)), pa.array(v)], names=["model", "i", "v"])

    out = {k: np.zeros(1 + len(b) + len(b) ** 2) for k, (_, b) in wanted.items()}
    for r in rows.mapInArrow(run, "model int, i int, v double").groupBy("model", "i").agg(F.sum("v").alias("v")).collect():
        out[r.model][r.i] = r.v
    size = {k: len(b) for k, (_, b) in wanted.items()}
    return {k: (v[0], v[1 : 1 + size[k]], v[1 + size[k] :].reshape(size[k], size[k])) for k, v in out.items()}


def logistic(train: DataFrame, max_iter: int = 2000) -> Logit:
    return Logistic(max_iter)(train)


#: Rows of a task in a boosted fit: its cached points take about 200 bytes each.
ROWS_A_TASK = 1 << 20


def dealt(rows: DataFrame, n: int, most: int = ROWS_A_TASK) -> DataFrame:
    """n rows in tasks of `most` rows: a file's part of 128 MB may hold many times that."""
    return rows.repartition(-(-n // most)) if n > most else rows


def boosted(train: DataFrame, rounds: int = 500, depth: int = 6, rate: float = 0.05, subsample: float = 0.8, features: str = "0.8", validation: DataFrame | None = None, seed: int = 42, balanced: bool = True, stop: str = "loss", patience: int = 50):
    """Gradient-boosted trees, stopped early on the validation rows if there are any.

    stop: `loss` ends the training where Spark sees the loss rise; `auc` grows all rounds and keeps the trees up to
    the best ROC-AUC that no round of the `patience` after it beats, as best_by_auc() says.
    """
    from pyspark.ml.classification import GBTClassifier

    if stop not in ("loss", "auc"):
        raise ValueError(f"no such stop: {stop}")
    if stop == "auc" and validation is not None:
        whole = boosted(train, rounds, depth, rate, subsample, features, None, seed, balanced)
        return best_by_auc(whole, validation, patience)
    rows = train
    more = {}
    if validation is not None:
        rows = train.withColumn("validation", F.lit(False)).unionByName(validation.withColumn("validation", F.lit(True)))
        more["validationIndicatorCol"] = "validation"
    rows = dealt(rows, rows.count())
    rows = balanced_weights(rows) if balanced else rows.withColumn("weight", F.lit(1.0))
    return GBTClassifier(maxIter=rounds, maxDepth=depth, stepSize=rate, subsamplingRate=subsample, featureSubsetStrategy=features, weightCol="weight", seed=seed, **more).fit(rows)


def staged_auc(model, rows: DataFrame, block: int = 50) -> Iterator[tuple[int, float]]:
    """(rounds, ROC-AUC on the rows) of a boosted model's first trees, for 1, 2, ... of them.

    `block` trees are scored in one pass and their AUCs come from one aggregate; the sums so far are written between
    blocks. A caller that stops asking leaves the rest undone. One number a round reaches the driver.
    """
    at = rows.select("features", "label", F.lit(0.0).alias("margin"))
    written = None
    for start in range(0, len(model.trees), block):
        trees, own, sums = model.trees[start : start + block], at, []
        for k, (tree, weight) in enumerate(zip(trees, model.treeWeights[start : start + block])):
            own = tree.setPredictionCol(f"__t{k}").transform(own)
            sums.append(F.lit(float(weight)) * F.col(f"__t{k}"))
        steps = F.aggregate(F.array(*sums), F.array(F.col("margin")), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))
        table = settle(own.select("features", "label", steps.alias("steps")), "stages")
        scored = table.select("label", F.posexplode("steps").alias("stage", "score")).where("stage > 0")
        found = {r["stage"]: r["roc_auc"] for r in stats.roc_auc(scored, "label", "score", ["stage"]).collect()}
        at = table.select("features", "label", F.element_at("steps", -1).alias("margin"))
        if written is not None:
            discard(written)
        written = table
        for k in range(1, len(trees) + 1):
            yield start + k, found.get(k)
    if written is not None:
        discard(written)


def first_trees(model, n: int):
    """A boosted classifier of the first n trees."""
    from pyspark.ml.classification import GBTClassificationModel
    from pyspark.sql import SparkSession

    gateway = SparkSession.active().sparkContext._gateway
    jvm, own = gateway.jvm, model._java_obj
    trees = gateway.new_array(jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, n)
    weights = gateway.new_array(jvm.double, n)
    grown = own.trees()
    for i in range(n):
        trees[i], weights[i] = grown[i], float(model.treeWeights[i])
    return GBTClassificationModel(jvm.org.apache.spark.ml.classification.GBTClassificationModel(own.uid(), trees, weights))


def best_by_auc(model, validation: DataFrame, patience: int = 50):
    """The model of a boosted model's first trees with the best ROC-AUC on the validation rows, the first of equals.

    Rounds are looked at in order until `patience` of them bring no better one. Each round builds on those before it only, so
    this is the model that a training with this stop gives. Without rows of both classes all trees stay.
    """
    best, best_auc = 0, -1.0
    for rounds, auc in staged_auc(model, validation, patience):
        if auc is None:
            return model
        if auc > best_auc:
            best, best_auc = rounds, auc
        if rounds - best >= patience:
            break
    return first_trees(model, best) if best else model


def probabilities(model, df: DataFrame) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    return model.transform(df).withColumn("score", vector_to_array("probability")[1])


def evaluate(scored: DataFrame, label: str = "label", threshold: float = 0.5) -> dict[str, float]:
    """Accuracy, balanced accuracy, F1 and ROC-AUC."""
    row = stats.confusion(scored.withColumn("predicted", (F.col("score") >= threshold).cast("int")), label, "predicted").first().asDict()
    return row | {"roc_auc": stats.roc_auc(scored, label, "score").first()[0]}


def importances(model, columns: list[str]) -> DataFrame:
    """feature, importance, percent by decreasing gain, and the number of splits."""
    from pyspark.sql import SparkSession

    splits = dict.fromkeys(columns, 0)
    for line in model.toDebugString.splitlines():
        if "If (feature " in line:
            splits[columns[int(line.split("If (feature ")[1].split(" ")[0])]] += 1
    gains = model.featureImportances.toArray().tolist()
    total = sum(gains) or 1.0
    rows = sorted(((c, g, 100 * g / total, splits[c]) for c, g in zip(columns, gains)), key=lambda r: (-r[1], r[0]))
    return SparkSession.active().createDataFrame(rows, "feature string, importance double, percent double, splits int")


def glm_table(train: DataFrame, columns: list[str]) -> tuple[DataFrame, dict[str, float]]:
    """A binomial GLM: feature, coefficient, odds_ratio, p_value, direction, significant; and its likelihood-ratio test."""
    from pyspark.ml.regression import GeneralizedLinearRegression

    model = GeneralizedLinearRegression(family="binomial", link="logit", maxIter=100).fit(train)
    p = model.summary.pValues
    import math

    rows = [("const", model.intercept, math.exp(model.intercept), p[-1])]
    rows += [(c, b, math.exp(min(b, 700.0)), q) for c, b, q in zip(columns, model.coefficients.toArray().tolist(), p)]
    table = train.sparkSession.createDataFrame([(*r, "positive" if r[1] > 0 else "negative", bool(r[3] < 0.05)) for r in rows], "feature string, coefficient double, odds_ratio double, p_value double, direction string, significant boolean")
    lr = model.summary.nullDeviance - model.summary.deviance
    return table, {"lr": lr, "df": len(columns), "p_value": special.chi2_upper(lr, len(columns))}


def sweep(train: DataFrame, val: DataFrame, columns: list[str], count_col: str, models: dict[str, Callable], thresholds: list[int] = THRESHOLDS) -> DataFrame:
    """model, threshold, positive_rate and the metrics of each model on each label count > threshold. Columns are prepared and written once for all thresholds."""
    label = lambda t: exceeds(F.col(count_col), t).cast("double")
    kinds = train.agg(*[F.count_distinct(label(t)) for t in thresholds]).first() if thresholds else ()
    live = [t for t, n in zip(thresholds, kinds) if n > 1]
    rows = []
    if live:
        fitted = prepare(train, columns)  # knows nothing of the labels
        held = [settle(fitted.apply(d, count_col).select("features", F.col(count_col).alias("__count")), "sweep") for d in (train, val)]
        for t in live:
            ready = [d.select("features", exceeds(F.col("__count"), t).cast("double").alias("label")) for d in held]
            rate = ready[0].agg(F.avg("label")).first()[0]
            for name, fit in models.items():
                m = evaluate(probabilities(fit(ready[0]), ready[1]))
                rows.append((name, t, rate, m["accuracy"], m["balanced_accuracy"], m["f1_1"], m["roc_auc"]))
        discard(*held)
    schema = "model string, threshold int, positive_rate double, accuracy double, balanced_accuracy double, f1 double, roc_auc double"
    return train.sparkSession.createDataFrame(rows, schema).orderBy(F.desc("roc_auc"), "model", "threshold")


def ablate(train: DataFrame, val: DataFrame, label: str, configs: dict[str, list[str]], fit: Callable) -> DataFrame:
    """config, number, features, metrics and their differences from M0. Columns are prepared once, and each set of columns is fitted once.

    A `fit` with a method `together` fits all sets in the same passes, and all are evaluated in one.
    """
    from pyspark.ml.functions import array_to_vector

    every = list(dict.fromkeys(c for columns in configs.values() for c in columns))
    fitted = prepare(train, every)
    place = {c: i for i, c in enumerate(fitted.columns)}
    sets = {name: tuple(place[c] for c in dict.fromkeys(columns) if c in place) for name, columns in configs.items()}
    distinct = [list(c) for c in dict.fromkeys(c for c in sets.values() if c)]
    got: dict[tuple, tuple] = {}
    if distinct:
        ready = [settle(fitted.apply(d, label).select(F.array(*fitted.columns).alias("x"), "label"), "ablation") for d in (train, val)]
        if hasattr(fit, "together"):
            found = fit.together(ready[0], distinct)
            scores = [F.struct(F.lit(k).alias("config"), m.chance([F.element_at("x", i + 1) for i in own]).alias("score")) for k, (m, own) in enumerate(zip(found, distinct))]
            scored = ready[1].select("label", F.explode(F.array(*scores)).alias("s")).select("label", "s.*").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
            auc = {r.config: r.roc_auc for r in stats.roc_auc(scored, "label", "score", ["config"]).collect()}
            got = {tuple(distinct[r.config]): (r.accuracy, r.balanced_accuracy, auc[r.config]) for r in stats.confusion(scored, "label", "predicted", ["config"]).collect()}
        else:
            for own in distinct:
                parts = [d.select(array_to_vector(F.array(*[F.element_at("x", i + 1) for i in own])).alias("features"), "label") for d in ready]
                m = evaluate(probabilities(fit(parts[0]), parts[1]))
                got[tuple(own)] = (m["accuracy"], m["balanced_accuracy"], m["roc_auc"])
        discard(*ready)
    rows = [(name, int(name[1:]), len(own), *got[own]) for name, own in sets.items() if own in got]
    base = next((r for r in rows if r[0] == "M0"), None)
    rows = [(*r, *((r[k] - base[k]) if base else None for k in (3, 4, 5))) for r in rows]
    schema = "config string, number int, features int, accuracy double, balanced_accuracy double, roc_auc double, delta_accuracy double, delta_balanced_accuracy double, delta_roc_auc double"
    return train.sparkSession.createDataFrame(rows, schema).orderBy("number")
