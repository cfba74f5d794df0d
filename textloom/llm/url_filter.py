"""URL filter: rules first, then trust and distrust propagated over the link graph of hosts.

All steps are DataFrame and SQL functions. A rule (verdict, host, path) fits its host and every subdomain where
the URL's path starts with the rule's; the longest rule wins (of equal lengths, the longer host, then `block`).
Pages without a rule get the verdict of their host: personalised PageRank spreads trust along links from
trusted hosts, and, on the reversed links, distrust from blocked hosts to those that link to them. A host is a
trusted (blocked) seed if more than half of its pages are allowed (blocked) by rules. A host is blocked if its
distrust exceeds its trust by more than `margin`; hosts that neither reaches are allowed.

Links are the absolute or protocol-relative `href`s of `a` elements; relative links stay on their host and count
as none. Edges are counted per pair of hosts before they meet, so neither a hot host nor repeated pages give
large groups; each round is written to the shared folder. Null or unparsable URLs have an empty host, which no
rule fits and which takes no part in the graph; null html has no links, and of html of any length all links count. An empty
table gives an empty result, null and repeated page_ids their rows. Extra and clashing columns don't reach the result.

In the graph a host stands without user and port, on pages as in links. `rounds`, `damping` and `margin` are parameters, and the SQL writes the same rounds
out: hosts more than `rounds` links from a seed count as not reached, and scores shrink with the number of seeds. With rounds = EXACT walks go on until a round
reaches no new host and changes no score by more than `tolerance` of itself, and with relative = True the margin is a share of what one seed
holds, so verdicts don't depend on how many seeds there are. The mass of hosts without out-links isn't handed back to the seeds: that would scale
trust and distrust each by a factor, and is left out of both alike.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import urls
from .common import discard, settle

#: Rules that are compiled into one CASE; with more, the hosts' suffixes meet the rules' hosts by a join.
CASE_RULES = 100
#: As rounds: until nothing changes.
EXACT = 0
TOLERANCE = 1e-6
#: Guards against a fault only: scores change by less than damping ** rounds of a seed's mass.
MOST_ROUNDS = 500

_LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s<>]+)"""


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str = "/"

    @property
    def name(self) -> str:
        return self.host + self.path


def best_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """struct(name, verdict) of the rule that wins, or null: one CASE in the order of precedence, compiled into the scan's stage."""
    order = sorted(rules, key=lambda r: (-len(r.name), -len(r.host), r.verdict != "block", r.name))
    out = None
    for r in order:
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        value = F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out if out is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def with_rules(pages: DataFrame, rules: list[Rule], case_rules: int = CASE_RULES) -> DataFrame:
    """Adds rule and verdict, of the rule that wins or null, to pages with host and path."""
    if len(rules) <= case_rules:
        found = pages.withColumn("__best", best_rule(F.col("host"), F.col("path"), rules))
        return found.withColumns({"rule": F.col("__best.rule"), "verdict": F.col("__best.verdict")}).drop("__best")
    order = sorted(rules, key=lambda r: (-len(r.name), -len(r.host), r.verdict != "block", r.name))
    table = pages.sparkSession.createDataFrame([(i, r.host, r.path, r.name, r.verdict) for i, r in enumerate(order)], "place int, suffix string, start string, rule string, verdict string")
    parts = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    asked = pages.select("host", "path").distinct().withColumn("suffix", F.explode(suffixes))
    fits = asked.join(table, "suffix").where(F.col("path").startswith(F.col("start")))
    best = fits.groupBy("host", "path").agg(F.min_by(F.struct("rule", "verdict"), "place").alias("__best"))
    return pages.join(best, ["host", "path"], "left").withColumns({"rule": F.col("__best.rule"), "verdict": F.col("__best.verdict")}).drop("__best")


def node(host: Column) -> Column:
    """A host without user and port, as it stands in the graph."""
    return F.lower(F.regexp_replace(host, r"^[^@]*@|:\d*$", ""))


def host_edges(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """src, dst, weight: on how many pages of src some link leads to dst; no loops."""
    links = F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(html_col, F.lit("")), F.lit(_LINK), 1), node))
    out = pages.where("host <> ''").select(node(F.col("host")).alias("src"), F.explode(links).alias("dst"))
    return out.where("dst <> src and dst <> '' and src <> ''").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("weight"))


def propagate(edges: DataFrame, seeds: DataFrame, rounds: int = 8, damping: float = 0.85, tolerance: float = TOLERANCE) -> DataFrame:
    """host, score: personalised PageRank from seeds(host) over edges(src, dst, weight); seeds share a mass of 1. Tables of earlier rounds are deleted."""
    n = seeds.count()
    start = seeds.select("host", F.lit(1.0 / max(1, n)).alias("seed"))
    out_weight = edges.groupBy("src").agg(F.sum("weight").alias("all"))
    flow = settle(edges.join(out_weight, "src").select("src", "dst", (F.col("weight") / F.col("all") * damping).alias("share")), "flow")
    start = settle(start, "seeds")
    score, written = start.withColumnRenamed("seed", "score"), None
    for k in range(rounds or MOST_ROUNDS):
        moved = flow.join(score.withColumnRenamed("host", "src"), "src").select(F.col("dst").alias("host"), (F.col("share") * F.col("score")).alias("score"))
        again = start.select("host", (F.col("seed") * (1 - damping)).alias("score"))
        new = settle(moved.unionByName(again).groupBy("host").agg(F.sum("score").alias("score")), "rank")
        done = False
        if not rounds:
            old = score.select(F.col("host").alias("__host"), F.col("score").alias("__score"))
            far = F.col("__score").isNull() | (F.abs(F.col("score") - F.col("__score")) > tolerance * F.col("score"))
            done = new.join(old, F.col("host") == F.col("__host"), "left").where(far).isEmpty()
        if written is not None:
            discard(written)
        score = written = new
        if done:
            break
    discard(flow)
    if written is not None:
        discard(start)
    return score


def blocked_hosts(ruled: DataFrame, edges: DataFrame, rounds: int = 8, damping: float = 0.85, margin: float = 1e-9, relative: bool = False, tolerance: float = TOLERANCE) -> DataFrame:
    """The hosts whose distrust exceeds their trust. ruled: a row per page with host and verdict (null without a rule)."""
    share = lambda v: F.avg(F.when(F.col("verdict") == v, 1.0).otherwise(0.0))
    own = ruled.withColumn("host", node(F.col("host"))).where("host <> ''")
    hosts = settle(own.groupBy("host").agg(share("allow").alias("allowed"), share("block").alias("blocked")), "hosts")
    trusted, distrusted = hosts.where("allowed > 0.5").select("host"), hosts.where("blocked > 0.5").select("host")
    trust = propagate(edges, trusted, rounds, damping, tolerance)
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    distrust = propagate(back, distrusted, rounds, damping, tolerance)
    if relative:
        margin = margin / max(1, trusted.count(), distrusted.count())
    both = distrust.withColumnRenamed("score", "distrust").join(trust.withColumnRenamed("score", "trust"), "host", "left")
    return both.where(F.col("distrust") > F.coalesce("trust", F.lit(0.0)) + margin).select("host")


def judge(pages: DataFrame, rules: list[Rule], rounds: int = 8, damping: float = 0.85, margin: float = 1e-9, relative: bool = False, tolerance: float = TOLERANCE) -> DataFrame:
    """page_id, host, path, rule, verdict of every page (page_id, url, html)."""
    parsed = pages.select("page_id", urls.host(F.col("url")).alias("host"), urls.path(F.col("url")).alias("path"), "html")
    ruled = with_rules(parsed, rules)
    edges = settle(host_edges(ruled), "edges")
    bad = settle(blocked_hosts(ruled.drop("html"), edges, rounds, damping, margin, relative, tolerance).select(F.col("host").alias("__node"), F.lit(True).alias("__bad")), "blocked")
    discard(edges)
    judged = ruled.drop("html").join(bad, node(F.col("host")) == F.col("__node"), "left")
    method = F.when(F.col("__bad"), F.lit("block")).otherwise(F.lit("allow"))
    return judged.select("page_id", "host", "path", "rule", F.coalesce("verdict", method).alias("verdict"))


def oracle_sql(rules: list[Rule], rounds: int = 8, damping: float = 0.85, margin: float = 1e-9) -> str:
    """judge() over the view `pages` in DuckDB's SQL, the rounds written out."""
    order = sorted(rules, key=lambda r: (-len(r.name), -len(r.host), r.verdict != "block", r.name))
    fits = [f"(host = '{r.host}' or ends_with(host, '.{r.host}')) and starts_with(path, '{r.path}')" for r in order]
    pick = lambda values: "case " + " ".join(f"when {f} then '{v}'" for f, v in zip(fits, values)) + " end" if fits else "null::varchar"
    link = _LINK.replace("'", "''")
    ctes = [
        "rest as (select page_id, coalesce(html, '') as html, case when contains(url, '://') then substr(url, instr(url, '://') + 3) else '' end as rest from pages)",
        f"parsed as (select page_id, html, translate(regexp_extract(rest, '^[^/?#]*', 0), '{urls.UPPER}', '{urls.LOWER}') as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from rest)",
        f"ruled as (select page_id, html, host, lower(regexp_replace(host, '^[^@]*@|:\\d*$', '', 'g')) as node, path, {pick([r.name for r in order])} as rule, {pick([r.verdict for r in order])} as verdict from parsed)",
        f"links as (select page_id, node as src, unnest(list_distinct(list_transform(regexp_extract_all(html, '{link}', 1), lambda x: lower(regexp_replace(x, '^[^@]*@|:\\d*$', '', 'g'))))) as dst from ruled where host <> '')",
        "edges as (select src, dst, count(*) as weight from links where dst <> src and dst <> '' and src <> '' group by src, dst)",
        "hosts as (select node as host, avg(case when verdict = 'allow' then 1.0 else 0.0 end) as allowed, avg(case when verdict = 'block' then 1.0 else 0.0 end) as blocked from ruled where node <> '' group by node)",
    ]
    for kind, column, a, b in (("t", "allowed", "src", "dst"), ("d", "blocked", "dst", "src")):
        ctes.append(f"{kind}s as (select host, 1.0::double / count(*) over () as seed from hosts where {column} > 0.5)")
        ctes.append(f"{kind}f as (select {a} as src, {b} as dst, weight::double / sum(weight) over (partition by {a}) * {damping} as share from edges)")
        ctes.append(f"{kind}0 as (select host, seed as score from {kind}s)")
        for i in range(rounds):
            moved = f"select f.dst as host, f.share * r.score as score from {kind}f f join {kind}{i} r on f.src = r.host"
            ctes.append(f"{kind}{i + 1} as materialized (select host, sum(score) as score from ({moved} union all select host, seed * {1 - damping} from {kind}s) group by host)")
    ctes.append(f"bad as (select d.host from d{rounds} d left join t{rounds} t on t.host = d.host where d.score > coalesce(t.score, 0) + {margin})")
    return f"with {', '.join(ctes)} select page_id, r.host, path, rule, coalesce(verdict, case when bad.host is not null then 'block' else 'allow' end) as verdict from ruled r left join bad on bad.host = r.node"

