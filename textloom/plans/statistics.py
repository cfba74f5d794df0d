"""Queries of descriptive statistics, tests, correlations, metrics, rank fusion and models."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import boosting, cleaning, importance, models, prep, stats
from ..sources.readers import table
from .registry import query, r, round_all, rounded
from .tabular import _GAPS, PAPERS, gaps, papers

NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def lines(spark, folder):
    return table(spark, folder, "lineitem").withColumn("y", (F.col("l_returnflag") == "R").cast("int"))


def _union(columns, select):
    return " union all ".join(select.format(c=c) for c in columns)


_SUMMARY = f"count(v) as n, count(*) - count(v) as missing, {r('(count(*) - count(v)) / count(*)')} as missing_rate, {r('avg(v)')} as mean, {r('stddev_samp(v)')} as std, {r('min(v)')} as min, {r('quantile_cont(v, 0.25)')} as p25, {r('median(v)')} as median, {r('quantile_cont(v, 0.75)')} as p75, {r('max(v)')} as max"
_LONG_GAPS = "l as (" + _union(["q", "p", "l_discount", "l_tax"], "select '{c}' as feature, case when isnan({c}) then null else {c} end as v, coalesce(mode, 'Missing') as mode from gaps") + ")"


@query("numeric_summary", f"with {_GAPS}, {_LONG_GAPS} select feature, {_SUMMARY} from l group by feature")
def numeric_summary(spark, folder):
    return round_all(stats.summary(gaps(spark, folder), ["q", "p", "l_discount", "l_tax"]))


@query("numeric_summary_by_group", f"with {_GAPS}, {_LONG_GAPS} select mode, feature, {_SUMMARY} from l group by mode, feature")
def numeric_summary_by_group(spark, folder):
    own = gaps(spark, folder).withColumn("mode", F.coalesce("mode", F.lit("Missing")))
    return round_all(stats.summary(own, ["q", "p", "l_discount", "l_tax"], ["mode"]))


@query("value_counts_share", f"select lang as value, count(*) as n, {r('count(*) / sum(count(*)) over ()')} as share from documents group by lang")
def value_counts_share(spark, folder):
    return round_all(stats.value_counts(table(spark, folder, "documents"), "lang"))


@query("missing_summary", f"with {_GAPS} " + _union(["l_orderkey", "q", "p", "mode"], f"select '{{c}}' as feature, count(*) - count({{c}}) as missing, {r('(count(*) - count({c})) / count(*)')} as missing_rate from gaps"))
def missing_summary(spark, folder):
    return round_all(stats.missing_summary(gaps(spark, folder).select("l_orderkey", "q", "p", "mode")))


@query("histogram", f"with e as (select min(l_extendedprice) lo, max(l_extendedprice) hi, count(*) total from lineitem), b as (select least(floor((l_extendedprice - lo) / ((hi - lo) / 50)), 49)::bigint as bin, lo, (hi - lo) / 50 as w, total from lineitem, e) select bin, {r('lo + bin * w')} as low, {r('lo + (bin + 1) * w')} as high, count(*) as n, {r('count(*) / (total * w)', 9)} as density from b group by bin, lo, w, total")
def histogram(spark, folder):
    own = stats.histogram(table(spark, folder, "lineitem"), "l_extendedprice")
    return own.select(F.col("bin").cast("long").alias("bin"), rounded("low").alias("low"), rounded("high").alias("high"), "n", rounded("density", 9).alias("density"))


@query("log_histogram", f"with v as (select ln(1 + l_extendedprice) as v from lineitem where l_extendedprice > 0), e as (select min(v) lo, max(v) hi, count(*) total from v), b as (select least(floor((v - lo) / ((hi - lo) / 20)), 19)::bigint as bin from v, e) select bin, count(*) as n from b group by bin")
def log_histogram(spark, folder):
    return round_all(stats.histogram(table(spark, folder, "lineitem"), "l_extendedprice", 20, log=True).select("bin", "n"))


@query("box_stats", f"with b as (select l_returnflag, quantile_cont(l_extendedprice, 0.25) q1, median(l_extendedprice) md, quantile_cont(l_extendedprice, 0.75) q3 from lineitem group by l_returnflag), j as (select b.*, l_extendedprice as v, l_extendedprice between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1) as inside from lineitem join b using (l_returnflag)) select l_returnflag, {r('q1')} as q1, {r('md')} as median, {r('q3')} as q3, {r('min(v) filter (inside)')} as whisker_low, {r('max(v) filter (inside)')} as whisker_high, count(*) filter (not inside) as outliers, count(*) as n from j group by l_returnflag, q1, md, q3")
def box_stats(spark, folder):
    return round_all(stats.box_stats(table(spark, folder, "lineitem"), "l_extendedprice", "l_returnflag"))


@query("one_hot_summary", f"with h as (select l_returnflag, (l_linestatus = 'O')::int as linestatus_o, (l_linestatus = 'F')::int as linestatus_f from lineitem) " + _union(["linestatus_o", "linestatus_f"], f"select '{{c}}' as feature, l_returnflag, {r('sum({c})')} as total, {r('avg({c})')} as share, count(*) as group_size from h group by l_returnflag"))
def one_hot_summary(spark, folder):
    own = table(spark, folder, "lineitem").select("l_returnflag", *[(F.col("l_linestatus") == x).cast("int").alias(f"linestatus_{x.lower()}") for x in "OF"])
    return round_all(stats.one_hot_summary(own, ["linestatus_o", "linestatus_f"], "l_returnflag"))


@query(
    "mann_whitney_u",
    "with l as (" + _union(NUMBERS, "select '{c}' as feature, {c} as v, (l_returnflag = 'R')::int as y from lineitem") + f"""),
k as (select *, rank() over (partition by feature order by v) + (count(*) over (partition by feature, v) - 1) / 2.0 as rk, count(*) over (partition by feature, v) as t from l),
s as (select feature, count(*) filter (y = 0) as n0, count(*) filter (y = 1) as n1, sum(rk::double) filter (y = 0) as r0, avg(v) filter (y = 0) as m0, avg(v) filter (y = 1) as m1, median(v) filter (y = 0) as d0, median(v) filter (y = 1) as d1, sum((t * t - 1)::double) as ties from k group by feature)
select feature, n0, n1, {r('r0 - n0 * (n0 + 1) / 2.0', 3)} as u, {r('2 * (r0 - n0 * (n0 + 1) / 2.0) / (n0 * n1) - 1')} as rank_biserial, {r('ties', 0)} as ties, {r('m1 - m0')} as mean_difference, {r('d1 - d0')} as median_difference from s""",
)
def mann_whitney_u(spark, folder):
    own = stats.rank_sums(lines(spark, folder), NUMBERS, "y")
    return own.select("feature", "n0", "n1", rounded("u", 3).alias("u"), rounded("rank_biserial").alias("rank_biserial"), rounded("ties", 0).alias("ties"), rounded("mean_difference").alias("mean_difference"), rounded("median_difference").alias("median_difference"))


def _two_sided(bound, density):
    """What a symmetric density leaves beyond +-bound, by Simpson's rule of 2000 steps."""
    return f"1 - 2 * {bound} / 6000 * list_sum(list_transform(range(0, 2001), lambda i: (case when i in (0, 2000) then 1 when i % 2 = 1 then 4 else 2 end) * {density(f'(i * {bound} / 2000)')}))"


_NORMAL = lambda x: f"exp(-{x} * {x} / 2) / sqrt(2 * pi())"
_STUDENT = lambda x: f"exp(lgamma((v + 1) / 2) - lgamma(v / 2)) / sqrt(v * pi()) * pow(1 + {x} * {x} / v, -(v + 1) / 2)"


@query(
    "mann_whitney_tests",
    "with l as (" + _union(NUMBERS, "select '{c}' as feature, {c} as v, (l_returnflag = 'R')::int as y from lineitem") + f"""),
k as (select *, rank() over (partition by feature order by v) + (count(*) over (partition by feature, v) - 1) / 2.0 as rk, count(*) over (partition by feature, v) as t from l),
s as (select feature, count(*) filter (y = 0) as n0, count(*) filter (y = 1) as n1, sum(rk::double) filter (y = 0) - n0 * (n0 + 1) / 2.0 as u, avg(v) filter (y = 0) as m0, avg(v) filter (y = 1) as m1, median(v) filter (y = 0) as d0, median(v) filter (y = 1) as d1, sum((t * t - 1)::double) as ties from k group by feature),
z as (select *, least(40.0, greatest(0, abs(u - n0 * n1 / 2) - 0.5) / sqrt(n0 * n1 / 12 * (n0 + n1 + 1 - ties / ((n0 + n1) * (n0 + n1 - 1)))))::double as z from s)
select feature, n0, n1, {r('u')} as u, {r('2 * u / (n0 * n1) - 1')} as rank_biserial, {r('m0')} as mean0, {r('m1')} as mean1, {r('d0')} as median0, {r('d1')} as median1, {r('m1 - m0')} as mean_difference, {r('d1 - d0')} as median_difference, {r(_two_sided('z', _NORMAL))} as p_value from z where n0 >= 5 and n1 >= 5""",
)
def mann_whitney_tests(spark, folder):
    return round_all(stats.mann_whitney(lines(spark, folder), NUMBERS, "y"))


@query(
    "spearman",
    "with l as (" + _union(["l_quantity", "l_discount", "l_tax"], "select '{c}' as feature, {c} as x, l_extendedprice as t from lineitem where l_partkey % 10 <> 0") + f"""),
k as (select *, rank() over (partition by feature order by x) + (count(*) over (partition by feature, x) - 1) / 2.0 as rx, rank() over (partition by feature order by t) + (count(*) over (partition by feature, t) - 1) / 2.0 as ry from l)
select feature, count(*) as n, {r('corr(rx::double, ry::double)')} as rho from k group by feature having count(*) >= 10""",
)
def spearman(spark, folder):
    own = lines(spark, folder).withColumn("target", F.when(F.col("l_partkey") % 10 != 0, F.col("l_extendedprice")))
    return round_all(stats.spearman(own, ["l_quantity", "l_discount", "l_tax"], "target"))


@query(
    "spearman_tests",
    "with l as (" + _union(["l_quantity", "l_discount", "l_tax"], "select '{c}' as feature, {c} as x, l_extendedprice as t from lineitem") + f"""),
k as (select *, rank() over (partition by feature order by x) + (count(*) over (partition by feature, x) - 1) / 2.0 as rx, rank() over (partition by feature order by t) + (count(*) over (partition by feature, t) - 1) / 2.0 as ry from l),
c as (select feature, count(*) as n, corr(rx::double, ry::double) as rho from k group by feature having count(*) >= 10),
z as (select *, (n - 2)::double as v, least(60.0, abs(rho) * sqrt((n - 2) / (1 - rho * rho)))::double as z from c)
select feature, n, {r('rho')} as rho, {r(_two_sided('z', _STUDENT))} as p_value from z""",
)
def spearman_tests(spark, folder):
    return round_all(stats.spearman_tests(lines(spark, folder), ["l_quantity", "l_discount", "l_tax"], "l_extendedprice"))


_PAIRS = [(a, b) for i, a in enumerate(NUMBERS) for b in NUMBERS[i + 1 :]]


@query("pearson_matrix", " union all ".join(f"select '{a}' as a, '{b}' as b, {r(f'corr({a}, {b})')} as r from lineitem" for a, b in _PAIRS))
def pearson_matrix(spark, folder):
    return round_all(stats.correlation_matrix(table(spark, folder, "lineitem"), NUMBERS))


@query("spearman_matrix", " union all ".join(f"(with k as (select rank() over (order by {a}) + (count(*) over (partition by {a}) - 1) / 2.0 as rx, rank() over (order by {b}) + (count(*) over (partition by {b}) - 1) / 2.0 as ry from lineitem) select '{a}' as a, '{b}' as b, {r('corr(rx::double, ry::double)')} as r from k)" for a, b in _PAIRS))
def spearman_matrix(spark, folder):
    return round_all(stats.correlation_matrix(table(spark, folder, "lineitem"), NUMBERS, ranks=True))


@query("high_corr_drop", "with p as (select *, l_quantity * 2 + 0.001 * l_tax as doubled from lineitem), c as (select abs(corr(l_quantity, l_extendedprice)) > 0.95 as x1, abs(corr(l_quantity, doubled)) > 0.95 or abs(corr(l_extendedprice, doubled)) > 0.95 as x2 from p) select 'l_extendedprice' as feature from c where x1 union all select 'doubled' from c where x2")
def high_corr_drop(spark, folder):
    own = table(spark, folder, "lineitem").withColumn("doubled", F.col("l_quantity") * 2 + 0.001 * F.col("l_tax"))
    return spark.createDataFrame([(c,) for c in prep.highly_correlated(own, ["l_quantity", "l_extendedprice", "doubled"])], "feature string")


@query("duplicate_columns", "with p as (select l_quantity, l_tax, l_tax as copy from lineitem) select * from (select 'copy' as feature, case when count(*) filter (copy is distinct from l_quantity) = 0 then 'l_quantity' when count(*) filter (copy is distinct from l_tax) = 0 then 'l_tax' end as earlier from p union all select 'l_tax', case when count(*) filter (l_tax is distinct from l_quantity) = 0 then 'l_quantity' end from p) where earlier is not null")
def duplicate_columns(spark, folder):
    own = table(spark, folder, "lineitem").withColumn("copy", F.col("l_tax")).withColumn("id", F.concat_ws("-", "l_orderkey", "l_linenumber"))
    return spark.createDataFrame(cleaning.duplicate_columns(own, ["l_quantity", "l_tax", "copy"], "id"), "feature string, earlier string")


@query("constant_columns", "with p as (select l_tax, 1 as one from lineitem) select feature from (select 'l_tax' as feature, count(distinct l_tax) as n from p union all select 'one', count(distinct one) from p) where n <= 1")
def constant_columns(spark, folder):
    own = table(spark, folder, "lineitem").withColumn("one", F.lit(1))
    return spark.createDataFrame([(c,) for c in prep.constant_columns(own, ["l_tax", "one"])], "feature string")


_SCORED = "scored as (select (l_returnflag = 'R')::int as y, round(l_discount * 10 + l_tax, 1) as score from lineitem)"


def scored(spark, folder):
    return lines(spark, folder).select("y", F.round(F.col("l_discount") * 10 + F.col("l_tax"), 1).alias("score"))


@query("roc_auc", f"with {_SCORED}, k as (select *, rank() over (order by score) + (count(*) over (partition by score) - 1) / 2.0 as rk from scored) select {r('(sum(rk::double) filter (y = 1) - count(*) filter (y = 1) * (count(*) filter (y = 1) + 1) / 2.0) / (count(*) filter (y = 1) * count(*) filter (y = 0))')} as roc_auc from k")
def roc_auc(spark, folder):
    return round_all(stats.roc_auc(scored(spark, folder), "y", "score"))


@query(
    "confusion_report",
    f"""with {_SCORED}, c as (select count(*) filter (y = 0 and score < 0.5)::double tn, count(*) filter (y = 0 and score >= 0.5)::double fp, count(*) filter (y = 1 and score < 0.5)::double fn, count(*) filter (y = 1 and score >= 0.5)::double tp from scored),
d as (select *, tn / (tn + fn) p0, tn / (tn + fp) r0, tp / (tp + fp) p1, tp / (tp + fn) r1 from c), e as (select *, 2 * p0 * r0 / (p0 + r0) f0, 2 * p1 * r1 / (p1 + r1) f1 from d)
select tn::bigint as tn, fp::bigint as fp, fn::bigint as fn, tp::bigint as tp, {r('(tn + tp) / (tn + fp + fn + tp)')} as accuracy, {r('p0')} as precision_0, {r('r0')} as recall_0, {r('p1')} as precision_1, {r('r1')} as recall_1, (tn + fp)::bigint as support_0, (fn + tp)::bigint as support_1, {r('f0')} as f1_0, {r('f1')} as f1_1, {r('(r0 + r1) / 2')} as balanced_accuracy, {r('(f0 + f1) / 2')} as macro_f1, {r('(f0 * (tn + fp) + f1 * (fn + tp)) / (tn + fp + fn + tp)')} as weighted_f1 from e""",
)
def confusion_report(spark, folder):
    own = scored(spark, folder).withColumn("p", (F.col("score") >= 0.5).cast("int"))
    return round_all(stats.confusion(own, "y", "p"))


@query("class_weights", f"select count(*) as n, count(*) filter (l_returnflag = 'R') as positives, {r('count(*) filter (l_returnflag <> ' + chr(39) + 'R' + chr(39) + ') / count(*) filter (l_returnflag = ' + chr(39) + 'R' + chr(39) + ')')} as scale_pos_weight from lineitem")
def class_weights(spark, folder):
    return round_all(stats.class_weights(lines(spark, folder), "y"))


@query("threshold_sweep_rates", f"with {PAPERS} " + " union all ".join(f"select {t}::bigint as threshold, count(*) filter (citation_count > {t}) as positives, {r(f'avg((citation_count > {t})::int)')} as positive_rate from papers" for t in models.THRESHOLDS))
def threshold_sweep_rates(spark, folder):
    own = papers(spark, folder).select(F.explode(F.array(*[F.lit(x).cast("long") for x in models.THRESHOLDS])).alias("threshold"), "citation_count")
    hit = F.coalesce((F.col("citation_count") > F.col("threshold")).cast("int"), F.lit(0))
    return round_all(own.groupBy("threshold").agg(F.sum(hit).alias("positives"), F.avg(hit).alias("positive_rate")))


@query("topk_in_group", "select o_orderpriority, o_orderkey, row_number() over (partition by o_orderpriority order by o_totalprice desc, o_orderkey)::bigint as place from orders qualify place <= 10")
def topk_in_group(spark, folder):
    from pyspark.sql import Window

    w = Window.partitionBy("o_orderpriority").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, folder, "orders").select("o_orderpriority", "o_orderkey", F.row_number().over(w).cast("long").alias("place")).where("place <= 10")


@query("topk_head", "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 30")
def topk_head(spark, folder):
    return table(spark, folder, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(30)


#: Columns of papers as line items have them, in SQL that Spark and DuckDB share, and what five rankings of them are by.
PAPER_COLUMNS = {
    "year": "year(l_shipdate)", "paper_age": "month(l_shipdate)", "reference_count": "l_quantity", "max_author_hindex": "l_suppkey % 37", "num_authors": "l_linenumber",
    "abstract_perplexity": "l_partkey % 101", "flesch_mean": "l_discount", "abstract_flesch_mean": "l_tax", "n_words": "l_partkey", "title_length": "l_orderkey % 53",
    "grammar_edits": "l_quantity * l_tax", "confidence": "l_discount * l_quantity", "native_like_score": "l_suppkey % 11", "influence": "day(l_shipdate)",
    "primary_category_Physics": "case when l_returnflag = 'R' then 1 else 0 end", "publication_source_Other": "case when l_linestatus = 'O' then 1 else 0 end", "is_review": "case when l_returnflag = 'A' then 1 else 0 end",
}
RANKED_BY = {"gain": "l_extendedprice", "split": "l_quantity", "boost gain": "l_discount", "boost split": "l_tax", "logistic": "l_orderkey"}
LISTED = 10


def fused(spark, folder):
    """Each source's ten columns with the strongest correlation with what it ranks by."""
    own = table(spark, folder, "lineitem").selectExpr(*[f"{e} as `{c}`" for c, e in PAPER_COLUMNS.items()], *[f"{c} as t{i}" for i, c in enumerate(RANKED_BY.values())])
    found = stats.correlation_matrix(own, own.columns)
    name = F.create_map(*[F.lit(x) for i, source in enumerate(RANKED_BY) for x in (f"t{i}", source)])
    scores = found.where(F.col("a").isin(*PAPER_COLUMNS) & F.col("b").rlike("^t[0-9]$")).select(name[F.col("b")].alias("source"), F.col("a").alias("feature"), F.round(F.abs(F.coalesce("r", F.lit(0.0))), 9).alias("importance"))
    return importance.with_groups(importance.ranked_scores(scores, LISTED))


def _in(cols):
    return "(" + ", ".join(f"'{c}'" for c in cols) + ")"


_G = models.FEATURE_GROUPS
_FUSED = (
    "p as (select " + ", ".join(f'({e})::double as "{c}"' for c, e in PAPER_COLUMNS.items()) + ", " + ", ".join(f"{c}::double as t{i}" for i, c in enumerate(RANKED_BY.values())) + " from lineitem), "
    "scores(source, feature, importance) as (" + " union all ".join(f"""select '{source}', '{c}', round(abs(coalesce(corr("{c}", t{i}), 0)), 9) from p""" for i, source in enumerate(RANKED_BY) for c in PAPER_COLUMNS) + "), "
    f"placed as (select source, feature, row_number() over (partition by source order by importance desc, feature) as rank from scores), v as (select *, {LISTED} - rank + 1 as rank_score from placed where rank <= {LISTED}), "
    f"""f as (select *, case when feature in {_in(_G['temporal'])} then 'A. Temporal' when feature in {_in(_G['text_structure'])} then 'B. Text length / structural'
    when starts_with(feature, 'publication_source_') or feature in {_in(_G['publication_metadata'])} then 'C. Publication / indexing metadata' when feature = 'reference_count' then 'D. Reference count'
    when starts_with(feature, 'primary_category_') then 'E. Research field' when feature in {_in(_G['author_impact'])} then 'F. Author impact'
    when regexp_matches(feature, '{"|".join(importance.LINGUISTIC_WORDS)}') then 'G. Linguistic quality' else 'Other' end as main_group,
    case when feature in {_in(_G['grammar'])} then 'Grammatical accuracy' when feature in {_in(_G['nativeness'])} then 'Native-like language use' when contains(feature, 'abstract_perplexity') then 'Perplexity'
    when starts_with(feature, 'abstract_') and regexp_matches(feature, '{"|".join([*importance.READABILITY_WORDS, "readability"])}') then 'Abstract readability'
    when regexp_matches(feature, '{"|".join(importance.READABILITY_WORDS)}') then 'Paper readability' end as linguistic_group from v)"""
)
_SUMS = f"select feature, count(distinct source) as frequency, sum(rank_score)::bigint as total_rank_score, {r('avg(rank)')} as mean_rank, min(rank)::bigint as best_rank, min(main_group) as feature_group from f group by feature"


@query("rank_fusion", f"with {_FUSED} {_SUMS}")
def rank_fusion(spark, folder):
    return round_all(importance.feature_summary(fused(spark, folder)))


@query("rank_fusion_linguistic", f"with {_FUSED}, s as ({_SUMS}) select feature, total_rank_score from s where feature_group = 'G. Linguistic quality'")
def rank_fusion_linguistic(spark, folder):
    return importance.linguistic_features(importance.feature_summary(fused(spark, folder))).select("feature", "total_rank_score")


@query("rank_fusion_top_in_groups", f"with {_FUSED}, s as ({_SUMS}) select feature_group, feature, row_number() over (partition by feature_group order by frequency desc, total_rank_score desc, best_rank, feature)::bigint as place from s qualify place <= 3")
def rank_fusion_top_in_groups(spark, folder):
    own = importance.top_in_groups(importance.feature_summary(fused(spark, folder)), 3)
    return round_all(own.select("feature_group", "feature", "place"))


def _groups(by):
    return f"select {by}, count(feature) as total_mentions, count(distinct feature) as unique_features, sum(rank_score)::bigint as total_rank_score, {r('avg(rank_score)')} as mean_rank_score, max(rank_score)::bigint as max_rank_score from f where {by} is not null group by {by}"


@query("rank_fusion_groups", f"with {_FUSED} " + _groups("main_group"))
def rank_fusion_groups(spark, folder):
    return round_all(importance.group_summary(fused(spark, folder)))


@query("rank_fusion_linguistic_groups", f"with {_FUSED} " + _groups("linguistic_group"))
def rank_fusion_linguistic_groups(spark, folder):
    return round_all(importance.group_summary(fused(spark, folder), "linguistic_group"))


@query("group_max_pivot", f"with {_FUSED}, g(ordinal, main_group) as (values {', '.join(f'({i}, {chr(39)}{n}{chr(39)})' for i, n in enumerate(importance.GROUP_ORDER))}), m as (select main_group, source, max(rank_score) as m from f group by all) select ordinal::bigint as ordinal, g.main_group, " + ", ".join(f"coalesce(max(m) filter (source = '{src}'), 0)::bigint as \"{src}\"" for src in RANKED_BY) + f", {r('(' + ' + '.join(f'coalesce(max(m) filter (source = {chr(39)}{src}{chr(39)}), 0)' for src in RANKED_BY) + ') / 5.0')} as mean_of_max from g left join m using (main_group) group by ordinal, g.main_group")
def group_max_pivot(spark, folder):
    return round_all(importance.max_pivot(fused(spark, folder), list(RANKED_BY)))


@query("score_lookup", f"with {_FUSED}, s as (select feature, sum(rank_score)::double as importance from f where source in ('gain', 'split') group by feature) select distinct f.feature, coalesce(importance, 0)::double as importance from f left join s using (feature)")
def score_lookup(spark, folder):
    own = fused(spark, folder)
    scores = own.where("source in ('gain', 'split')").groupBy("feature").agg(F.sum("rank_score").alias("importance"))
    return importance.with_scores(own.select("feature").distinct(), scores)


@query("strongest_correlations", " union all ".join(f"select '{a}' as a, '{b}' as b, {r(f'corr({a}, {b})')} as r from lineitem" for a, b in _PAIRS) + " order by abs(r) desc, a limit 3")
def strongest_correlations(spark, folder):
    return stats.strongest(round_all(stats.correlation_matrix(table(spark, folder, "lineitem"), NUMBERS)), "r", 3)


@query("windowed_events", "select event_type, time_bucket(interval '1 hour', ts) as hour, count(*) as n, round(sum(value), 4) + 0.0 as total from events group by all")
def windowed_events(spark, folder):
    from ..streaming import stages

    own = stages.windowed_counts(table(spark, folder, "events"))  # the same on a batch as on a stream
    return own.select("event_type", F.col("window.start").cast("timestamp_ntz").alias("hour"), "n", rounded("total", 4).alias("total"))


FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "days"]


def sample_rows(spark, folder):
    """Line items with a count to predict and a split by a hash of their key."""
    key = F.concat_ws("-", "l_orderkey", "l_linenumber")
    own = table(spark, folder, "lineitem").withColumn("days", F.datediff("l_shipdate", F.lit("1992-01-01")).cast("double"))
    noise = F.pmod(F.xxhash64(key), F.lit(10))
    part = F.when(F.pmod(F.crc32(key), F.lit(5)) == 0, "val").otherwise("train")
    own = own.withColumn("count", F.floor(F.col("l_quantity") / 3 + F.col("l_discount") * 40 + noise)).withColumn("part", part)
    return own.where("part = 'train'"), own.where("part = 'val'")


def _fitted(spark, folder, threshold=10):
    train, val = (d.withColumn("y", (F.col("count") > threshold).cast("int")) for d in sample_rows(spark, folder))
    own = models.prepare(train, FEATURES, correlation=0.95)
    return own, own.apply(train, "y").select("features", "label"), own.apply(val, "y").select("features", "label")


def small_boosted(train):
    return models.boosted(train, rounds=8, depth=4, rate=0.3)


@query("glm")
def glm(spark, folder):
    own, train, _ = _fitted(spark, folder)
    return round_all(models.glm_table(train, own.columns)[0])


@query("logistic")
def logistic(spark, folder):
    own, train, val = _fitted(spark, folder)
    scored_rows = models.probabilities(models.logistic(train, 100), val)
    return spark.createDataFrame([(k, float(v)) for k, v in models.evaluate(scored_rows).items()], "metric string, value double")


@query("gbt")
def gbt(spark, folder):
    own, train, val = _fitted(spark, folder)
    model = models.boosted(train, rounds=10, depth=4, rate=0.3, validation=val)
    return round_all(models.importances(model, own.columns))


def gappy(spark, folder):
    """sample_rows() with a label, and without the days of one row in seven."""
    known = F.pmod(F.crc32(F.concat_ws("-", "l_linenumber", "l_orderkey")), F.lit(7)) != 0
    return [d.withColumn("y", (F.col("count") > 10).cast("int")).withColumn("days", F.when(known, F.col("days"))) for d in sample_rows(spark, folder)]


def _boosted(spark, folder, params):
    train, val = gappy(spark, folder)
    model = boosting.fit(train, FEATURES, "y", params, validation=val)
    auc = model.best_auc if model.best_auc is not None else stats.roc_auc(boosting.predict(model, val), "y", "score").first()[0]
    return round_all(boosting.importances(model, train).withColumns({"validation_auc": F.lit(auc), "trees": F.lit(len(model.trees))}))


#: The citation models' parameters, 500 rounds among them.
LEAF_WISE, SECOND_ORDER = boosting.LEAF_WISE, boosting.SECOND_ORDER


@query("leaf_wise_boosting")
def leaf_wise_boosting(spark, folder):
    return _boosted(spark, folder, LEAF_WISE)


@query("second_order_boosting")
def second_order_boosting(spark, folder):
    return _boosted(spark, folder, SECOND_ORDER)


@query("model_sweep")
def model_sweep(spark, folder):
    train, val = sample_rows(spark, folder)
    return round_all(models.sweep(train, val, FEATURES, "count", {"logistic": lambda d: models.logistic(d, 50), "boosted": small_boosted}, [10, 20]))


@query("ablation")
def ablation(spark, folder):
    train, val = (d.withColumn("y", (F.col("count") > 10).cast("int")) for d in sample_rows(spark, folder))
    groups = {"temporal": ["days"], "text_structure": ["l_quantity"], "reference_count": ["l_discount"], "author_impact": ["l_tax", "l_extendedprice"]}
    return round_all(models.ablate(train, val, "y", models.configurations(groups), models.Logistic(50)))
