"""Descriptive statistics, histograms, rank tests, correlations, classification metrics.

Families of columns are unpivoted and aggregated in one pass.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import special
from ..functions.scalars import finite
from ..sources.staging import settle
from .ordering import average_ranks, quantiles, with_running_sum, with_running_sums

#: Values of a feature whose ranks are broadcast to the rows, about.
FEW = 10_000


def long_form(df: DataFrame, columns: list[str], ids: list[str] | None = None) -> DataFrame:
    """feature, value (double, missing as NULL) and the id columns."""
    own = df.select(*(ids or []), *[finite(F.col(c)).alias(c) for c in columns])
    return own.unpivot(ids or [], columns, "feature", "value")


def _summary_aggs() -> list[Column]:
    v = F.col("value")
    n = F.count(F.lit(1))
    return [
        F.count(v).alias("n"),
        (n - F.count(v)).alias("missing"),
        ((n - F.count(v)) / n).alias("missing_rate"),
        F.avg(v).alias("mean"),
        F.stddev_samp(v).alias("std"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
    ]


def summary(df: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """n, missing, mean, std, quartiles and extremes of each feature, by group if asked for."""
    rows, keys = long_form(df, columns, by), [*(by or []), "feature"]
    out = _with_quantiles(rows.groupBy(*keys).agg(*_summary_aggs()), rows, "value", {"p25": 0.25, "median": 0.5, "p75": 0.75}, keys)
    return out.select(*keys, "n", "missing", "missing_rate", "mean", "std", "min", "p25", "median", "p75", "max")


def _with_quantiles(groups: DataFrame, rows: DataFrame, value: str, names: dict[str, float], keys: list[str]) -> DataFrame:
    """Adds quantiles of rows to a row for each group; NULL for groups without values."""
    found = quantiles(rows, value, list(names.values()), keys, list(names)).withColumnsRenamed({k: f"__q_{k}" for k in keys})
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"__q_{k}")) for k in keys))
    return groups.join(found, same, "left").drop(*[f"__q_{k}" for k in keys])


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """value, n, share; the total is one row."""
    counts = df.groupBy(F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return counts.crossJoin(F.broadcast(df.agg(F.count(F.lit(1)).alias("__all")))).select("value", "n", (F.col("n") / F.col("__all")).alias("share"))


def missing_summary(df: DataFrame) -> DataFrame:
    """feature, missing, missing_rate of every column, in one pass."""
    n = F.count(F.lit(1))
    row = df.agg(n.alias("__n"), *[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in df.columns])
    out = row.unpivot(["__n"], df.columns, "feature", "missing")
    return out.select("feature", "missing", F.try_divide(F.col("missing").cast("double"), F.col("__n").cast("double")).alias("missing_rate"))


def overview(df: DataFrame, groups: dict[str, list[str]]) -> DataFrame:
    """feature_group, expected, available, known: how many columns of each group df has, and in how many rows one of them is known."""
    own = {g: [c for c in cols if c in df.columns] for g, cols in groups.items()}
    some = {g: reduce(lambda a, b: a | b, (F.col(f"`{c}`").isNotNull() for c in cols), F.lit(False)) for g, cols in own.items()}
    row = df.agg(*[F.count_if(some[g]).alias(f"g{i}") for i, g in enumerate(groups)]).first() if groups else []
    rows = [(g, len(cols), len(own[g]), row[i]) for i, (g, cols) in enumerate(groups.items())]
    return df.sparkSession.createDataFrame(rows, "feature_group string, expected int, available int, known long")


def histogram(df: DataFrame, col: str, bins: int = 50, log: bool = False) -> DataFrame:
    """bin, low, high, n, density over equal widths between the extremes; the last bin is closed. log: of log1p of the positive values."""
    value = finite(F.col(col))
    own = df.select(value.alias("v")).where("v is not null")
    if log:
        own = own.where("v > 0").select(F.log1p("v").alias("v"))
    lo, hi, total = own.agg(F.min("v"), F.max("v"), F.count(F.lit(1))).first()
    width = (hi - lo) / bins if total else 0.0
    place = F.least(F.floor((F.col("v") - F.lit(lo)) / F.lit(width)), F.lit(bins - 1)) if width > 0 else F.lit(0)
    out = own.groupBy(place.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    low = F.lit(lo) + F.col("bin") * F.lit(width)
    return out.select("bin", low.alias("low"), (F.lit(lo) + (F.col("bin") + 1) * F.lit(width)).alias("high"), "n", F.try_divide(F.col("n").cast("double"), F.lit(float(total * width))).alias("density"))


def box_stats(df: DataFrame, col: str, by: str) -> DataFrame:
    """Quartiles, whiskers (extreme values within 1.5 IQR of the box) and outliers of each group."""
    own = df.select(F.col(by), finite(F.col(col)).alias("v")).where("v is not null")
    boxes = quantiles(own, "v", [0.25, 0.5, 0.75], [by], ["q1", "median", "q3"])
    low, high = F.col("q1") - 1.5 * (F.col("q3") - F.col("q1")), F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))
    inside = F.col("v").between(low, high)
    joined = own.join(boxes.withColumnRenamed(by, "__by"), F.col(by).eqNullSafe(F.col("__by"))).drop("__by")
    return joined.groupBy(by, "q1", "median", "q3").agg(F.min(F.when(inside, F.col("v"))).alias("whisker_low"), F.max(F.when(inside, F.col("v"))).alias("whisker_high"), F.count_if(~inside).alias("outliers"), F.count(F.lit(1)).alias("n"))


def one_hot_summary(df: DataFrame, columns: list[str], by: str) -> DataFrame:
    return long_form(df, columns, [by]).groupBy("feature", by).agg(F.sum("value").alias("total"), F.avg("value").alias("share"), F.count(F.lit(1)).alias("group_size"))


def rank_sums(df: DataFrame, columns: list[str], group: str) -> DataFrame:
    """What Mann-Whitney's test needs, of each feature: sizes, means and medians of the groups 0 and 1, U of group 0, ties and the effect size.

    Equal values are counted first; the ranks follow from running sums of the counts, dealt by ranges of the values.
    """
    rows = long_form(df, columns, [group]).where(f"value is not null and `{group}` in (0, 1)")
    first = F.col(group) == 0
    counted = rows.groupBy("feature", "value").agg(F.count_if(first).alias("c0"), F.count_if(~first).alias("c1"))
    t, d = F.col("t"), lambda c: F.col(c).cast("double")  # products of counts leave 64 bits at 2.1 million ties
    ranked = with_running_sum(counted.withColumn("t", F.col("c0") + F.col("c1")), "t", ["value"], ["feature"], "below").withColumn("rank", F.col("below") + (t + 1) / 2.0)
    sums = ranked.groupBy("feature").agg(F.sum("c0").alias("n0"), F.sum("c1").alias("n1"), F.sum(F.col("rank") * F.col("c0")).alias("r0"), F.sum(d("t") * d("t") * d("t") - d("t")).alias("ties"))
    of = lambda k: F.when(first if k == 0 else ~first, F.col("value"))
    means = rows.groupBy("feature").agg(*[F.avg(of(k)).alias(f"mean{k}") for k in (0, 1)])
    halves = quantiles(rows, "value", [0.5], ["feature", group])
    middle = halves.groupBy("feature").agg(*[F.max(F.when(F.col(group) == k, F.col("q0"))).alias(f"median{k}") for k in (0, 1)])
    means = means.join(middle, "feature")
    u = F.col("r0") - d("n0") * (d("n0") + 1) / 2.0
    out = sums.withColumn("u", u).withColumn("rank_biserial", F.try_divide(2 * F.col("u"), d("n0") * d("n1")) - 1)
    return out.join(means, "feature").withColumns({"mean_difference": F.col("mean1") - F.col("mean0"), "median_difference": F.col("median1") - F.col("median0")}).drop("r0")


def mann_whitney(df: DataFrame, columns: list[str], group: str, least: int = 5) -> DataFrame:
    """rank_sums with p values, for features with enough values in both groups. One row per feature reaches the driver."""
    rows = [r.asDict() for r in rank_sums(df, columns, group).where(f"n0 >= {least} and n1 >= {least}").collect()]
    for r in rows:
        r["p_value"] = special.mann_whitney_p(r["u"], r["n0"], r["n1"], r["ties"])
    schema = "feature string, n0 long, n1 long, u double, rank_biserial double, mean0 double, mean1 double, median0 double, median1 double, mean_difference double, median_difference double, p_value double"
    names = [x.split()[0] for x in schema.split(", ")]
    return df.sparkSession.createDataFrame([tuple(r[n] for n in names) for r in rows], schema)


def spearman(df: DataFrame, columns: list[str], target: str, least: int = 10) -> DataFrame:
    """feature, n, rho of each feature with the target over the rows where both are known.

    Features of at most FEW values have their ranks sent to the rows, and one aggregation by the target's values sums them all: the target is
    ranked for all of them in one order. For the others equal pairs are counted.
    """
    own = df.select(finite(F.col(target)).alias("__t"), *[finite(F.col(c)).alias(c) for c in columns]).where("__t is not null")
    about = own.agg(*[F.approx_count_distinct(c).alias(c) for c in columns]).first()
    few = [c for c in columns if about[c] <= FEW]
    rest = [c for c in columns if c not in few]
    found = [_few_valued(own, few)] if few else []
    if rest:
        found.append(_rank_correlation(own.unpivot(["__t"], rest, "feature", "value").where("value is not null"), ["feature"], "value", "__t"))
    return reduce(DataFrame.unionByName, found).where(F.col("n") >= least).select("feature", "n", "rho")


def _few_valued(own: DataFrame, columns: list[str]) -> DataFrame:
    """feature, n, rho of columns of few values with __t: sums over the values of __t of what the rows' ranks, less their mean, come to."""
    counted = settle(own.unpivot([], columns, "feature", "value").where("value is not null").groupBy("feature", "value").agg(F.count(F.lit(1)).alias("__n")), "counts")
    ranked = average_ranks(counted, "value", ["feature"], "__n", "__r").join(counted, ["feature", "value"])
    ranked = ranked.withColumn("__all", F.sum("__n").over(Window.partitionBy("feature")))  # about FEW rows each
    ranks = settle(ranked.select("feature", "value", "__n", "__all", (F.col("__r") - (F.col("__all") + 1) / 2.0).alias("__d")), "ranks")
    sums = {r.feature: (r.n, r.xx) for r in ranks.groupBy("feature").agg(F.sum("__n").alias("n"), F.sum(F.col("__n").cast("double") * F.col("__d") * F.col("__d")).alias("xx")).collect()}
    columns = [c for c in columns if c in sums]
    if not columns:
        return own.sparkSession.createDataFrame([], "feature string, n long, rho double")
    at, placed = range(len(columns)), own
    for k, c in enumerate(columns):
        one = ranks.where(F.col("feature") == c).select(F.col("value").alias(f"__v{k}"), F.col("__d").alias(f"__d{k}"))
        placed = placed.join(F.broadcast(one), F.col(c) == F.col(f"__v{k}"), "left")
    by = placed.groupBy("__t").agg(*[F.count(f"__d{k}").alias(f"n{k}") for k in at], *[F.coalesce(F.sum(f"__d{k}"), F.lit(0.0)).alias(f"s{k}") for k in at])
    below = with_running_sums(by, {f"below{k}": f"n{k}" for k in at}, ["__t"])
    dy = [F.col(f"below{k}") + (F.col(f"n{k}") - sums[c][0]) / 2.0 for k, c in enumerate(columns)]
    row = below.agg(*[F.sum(F.col(f"s{k}") * dy[k]).alias(f"xy{k}") for k in at], *[F.sum(F.col(f"n{k}") * dy[k] * dy[k]).alias(f"yy{k}") for k in at])
    each = [F.struct(F.lit(c).alias("feature"), F.lit(sums[c][0]).cast("long").alias("n"), F.try_divide(F.col(f"xy{k}"), F.sqrt(F.lit(sums[c][1])) * F.sqrt(f"yy{k}")).alias("rho")) for k, c in enumerate(columns)]
    return row.select(F.explode(F.array(*each)).alias("x")).select("x.*")


def _rank_correlation(rows: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """keys, n, rho: Spearman's of two columns. Equal pairs are counted before they meet their ranks."""
    pairs = settle(rows.groupBy(*keys, x, y).agg(F.count(F.lit(1)).alias("__n")), "pairs")
    ranked = pairs.join(average_ranks(pairs, x, keys, "__n", "rx"), [*keys, x]).join(average_ranks(pairs, y, keys, "__n", "ry"), [*keys, y])
    w, middle = F.col("__n").cast("double"), ranked.groupBy(*keys).agg(((F.sum("__n").cast("double") + 1) / 2).alias("__mid")).withColumnsRenamed({k: f"__k_{k}" for k in keys})
    same = reduce(lambda a, b: a & b, (F.col(k) == F.col(f"__k_{k}") for k in keys))
    dx, dy = F.col("rx") - F.col("__mid"), F.col("ry") - F.col("__mid")
    sums = ranked.join(middle, same).groupBy(*keys).agg(F.sum("__n").alias("n"), F.sum(w * dx * dy).alias("xy"), F.sum(w * dx * dx).alias("xx"), F.sum(w * dy * dy).alias("yy"))
    return sums.select(*keys, "n", F.try_divide(F.col("xy"), F.sqrt("xx") * F.sqrt("yy")).alias("rho"))


def spearman_tests(df: DataFrame, columns: list[str], target: str, least: int = 10, top: int | None = None) -> DataFrame:
    """spearman with p values, by decreasing strength; top: only so many."""
    rows = sorted(((r.feature, r.n, r.rho, special.correlation_p(r.rho, r.n)) for r in spearman(df, columns, target, least).collect()), key=lambda r: (-abs(r[2] or 0), r[0]))
    return df.sparkSession.createDataFrame(rows[:top], "feature string, n long, rho double, p_value double")


def masked_gram(df: DataFrame, columns: list[str]) -> DataFrame:
    """i, j, n, sx, sxx, sxy of every pair of columns over the rows where both are known: sums of x_i, its square and x_i x_j, less the columns' means.

    Each task multiplies batches of rows, with zeros for missing values, with themselves and with their masks, and hands on one row for each
    pair; Spark sums those of the tasks. So the work on rows is four matrix products, whatever the number of pairs.
    """
    import numpy as np
    import pyarrow as pa

    names = [f"x{i}" for i in range(len(columns))]
    own = df.select(*[finite(F.col(f"`{c}`")).alias(x) for c, x in zip(columns, names)])
    means = own.agg(*[F.avg(x).alias(x) for x in names]).first()
    shift = np.array([means[x] or 0.0 for x in names])

    def run(batches):
        p, sums = len(names), None
        for batch in batches:
            x = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in names], axis=1)
            known = (~np.isnan(x)).astype(float)
            x = np.where(known > 0, x - shift, 0.0)
            made = np.stack([known.T @ known, x.T @ known, (x * x).T @ known, x.T @ x])
            sums = made if sums is None else sums + made
        if sums is not None:
            i, j = np.divmod(np.arange(p * p, dtype=np.int32), p)
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), *(pa.array(s.ravel()) for s in sums)], names=["i", "j", "n", "sx", "sxx", "sxy"])

    parts = own.mapInArrow(run, "i int, j int, n double, sx double, sxx double, sxy double")
    return parts.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sxx", "sxy")])


def _correlations(df: DataFrame, columns: list[str]) -> list[tuple[int, int, float, float, float, float | None]]:
    """(i, j, n_i, n_j, n, r) of all pairs i < j; a few numbers for each pair reach the driver."""
    if len(columns) < 2:
        return []
    got = {(r.i, r.j): r for r in masked_gram(df, columns).collect()}
    out = []
    for i in range(len(columns)):
        for j in range(i + 1, len(columns)):
            if (i, j) not in got:  # no rows
                out.append((i, j, 0.0, 0.0, 0.0, None))
                continue
            a, b = got[i, j], got[j, i]
            xx, yy, n = a.n * a.sxx - a.sx**2, a.n * b.sxx - b.sx**2, a.n
            flat = min(xx, yy) <= 0 or xx <= 1e-12 * n * a.sxx or yy <= 1e-12 * n * b.sxx
            out.append((i, j, got[i, i].n, got[j, j].n, n, None if flat else (n * a.sxy - a.sx * b.sx) / xx**0.5 / yy**0.5))
    return out


def correlation_matrix(df: DataFrame, columns: list[str], ranks: bool = False) -> DataFrame:
    """a, b, r of all pairs of columns over the rows where both are known, NULL where one doesn't vary; ranks: Spearman's."""
    if not ranks:
        rows = [(columns[i], columns[j], r) for i, j, _, _, _, r in _correlations(df, columns)]
        return df.sparkSession.createDataFrame(rows, "a string, b string, r double")
    own = settle(df.select(*[finite(F.col(f"`{c}`")).alias(c) for c in columns]), "numbers")
    pairs = _correlations(own, columns)
    alike = [(i, j) for i, j, n, m, both, _ in pairs if n == m == both]  # missing in the same rows: each column has one ranking
    rest = [(columns[i], columns[j]) for i, j, n, m, both, _ in pairs if not n == m == both]
    out = df.sparkSession.createDataFrame([], "a string, b string, r double")
    if alike:
        used = sorted({k for pair in alike for k in pair})
        ranked = _ranked_columns(own, [columns[k] for k in used])
        place = {k: at for at, k in enumerate(used)}
        wanted = {(place[i], place[j]) for i, j in alike}
        found = [(columns[used[i]], columns[used[j]], r) for i, j, _, _, _, r in _correlations(ranked, [f"r{k}" for k in range(len(used))]) if (i, j) in wanted]
        out = out.unionByName(df.sparkSession.createDataFrame(found, "a string, b string, r double"))
    if rest:
        stacked = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}`").alias("x"), F.col(f"`{b}`").alias("y")) for a, b in rest]))
        rows = own.select(stacked.alias("p")).select("p.*").where("x is not null and y is not null")
        out = out.unionByName(_rank_correlation(rows, ["a", "b"], "x", "y").select("a", "b", F.col("rho").alias("r")))
    return out


def _ranked_columns(own: DataFrame, columns: list[str]) -> DataFrame:
    """r0, r1 ...: the mean rank of each value within its column, NULL for missing ones."""
    out = own.select(*[F.col(f"`{c}`").alias(f"v{k}") for k, c in enumerate(columns)])
    ranks = settle(average_ranks(long_form(out, out.columns).where("value is not null"), "value", ["feature"]), "ranks")
    for k in range(len(columns)):
        one = ranks.where(F.col("feature") == f"v{k}").select(F.col("value").alias(f"__v{k}"), F.col("rank").alias(f"r{k}"))
        out = out.join(one, F.col(f"v{k}") == F.col(f"__v{k}"), "left").drop(f"__v{k}")
    return out.select(*[f"r{k}" for k in range(len(columns))])


def strongest(df: DataFrame, by: str = "rho", k: int = 30) -> DataFrame:
    """The k rows of largest absolute value, in signed order."""
    return df.orderBy(F.abs(by).desc(), *[c for c in df.columns if c != by][:1]).limit(k).orderBy(by)


def confusion(df: DataFrame, label: str, predicted: str, by: list[str] | None = None) -> DataFrame:
    """tn, fp, fn, tp and what follows from them; one row, of each group if asked for."""
    y, p = F.col(label) == 1, F.col(predicted) == 1
    row = df.groupBy(*(by or [])).agg(F.count_if(~y & ~p).alias("tn"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"), F.count_if(y & p).alias("tp"))
    d = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    out = row.withColumns({"accuracy": d(tn + tp, tn + fp + fn + tp), "precision_0": d(tn, tn + fn), "recall_0": d(tn, tn + fp), "precision_1": d(tp, tp + fp), "recall_1": d(tp, tp + fn), "support_0": tn + fp, "support_1": fn + tp})
    f1 = lambda k: d(2 * F.col(f"precision_{k}") * F.col(f"recall_{k}"), F.col(f"precision_{k}") + F.col(f"recall_{k}"))
    out = out.withColumns({"f1_0": f1(0), "f1_1": f1(1), "balanced_accuracy": (F.col("recall_0") + F.col("recall_1")) / 2})
    total = F.col("support_0") + F.col("support_1")
    return out.withColumns({"macro_f1": (F.col("f1_0") + F.col("f1_1")) / 2, "weighted_f1": d(F.col("f1_0") * F.col("support_0") + F.col("f1_1") * F.col("support_1"), total)})


def roc_auc(df: DataFrame, label: str, score: str, by: list[str] | None = None, times: str | None = None) -> DataFrame:
    """roc_auc from rank sums, of each group if asked for, exact with ties; equal scores are counted before they are ranked. times: a column that says for how many rows each one stands."""
    by = by or []
    n = F.lit(1) if times is None else F.col(times)
    own = df.select(*by, (F.col(label) == 1).alias("y"), F.col(score).cast("double").alias("value"), n.cast("long").alias("n")).where("value is not null")
    counted = own.groupBy(*by, "value").agg(F.sum(F.when(F.col("y"), F.col("n")).otherwise(0)).alias("c1"), F.sum("n").alias("t"))
    ranked = with_running_sum(counted, "t", ["value"], by, "below").withColumn("r", F.col("below") + (F.col("t") + 1) / 2.0)
    row = ranked.groupBy(*by).agg(F.sum(F.col("r") * F.col("c1")).alias("r1"), F.sum("c1").alias("n1"), F.sum("t").alias("n"))
    n1, n = F.col("n1").cast("double"), F.col("n").cast("double")
    return row.select(*by, F.try_divide(F.col("r1") - n1 * (n1 + 1) / 2.0, n1 * (n - n1)).alias("roc_auc"))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """n, positives and the weight neg / pos of the positive class."""
    row = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(label) == 1).alias("positives"))
    return row.withColumn("scale_pos_weight", F.try_divide((F.col("n") - F.col("positives")).cast("double"), F.col("positives").cast("double")))
