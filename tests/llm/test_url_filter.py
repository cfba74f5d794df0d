import re

import pytest

from textloom.llm import url_filter as u
from textloom.llm.queries import OP4_RULES as RULES


def parse(url):
    rest = (url or "").partition("://")[2]
    m = re.match(r"([^/?#]*)([^?#]*)", rest)
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in m[1])
    return low, m[2]


def rule(host, path):
    fit = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fit, key=lambda r: len(r.name), default=None)


URLS = ["http://a.net/", "http://net/x", "http://a.net", "http://a.example.net/en/1?q#f", "HTTP://EXAMPLE.NET/en/", "https://xexample.com/de/", "https://m.example.com/de/?x", "http://example.com/DE/", "x.org/fr/", "ftp://É.org/fr/a#b", "http://u:p@a.net:80/", "://net/", "a://b://net/", "http://inet/", None, "", "http://", "http:///en/", "http://a.org?x/fr/"]


def test_hosts_paths_and_rules(spark):
    df = spark.createDataFrame([(i, x, None) for i, x in enumerate(URLS)], "page_id long, url string, html string")
    got = {r.page_id: r for r in u.judge(df, RULES).collect()}
    for i, x in enumerate(URLS):
        host, path = parse(x)
        best = rule(host, path)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, best and best.name), x
        if best:
            assert got[i].verdict == best.verdict


def page(i, host, *to):
    return i, f"http://{host}/p", "".join(f'<a class="x" href="https://{t}/q">t</a>' for t in to) + '<a href="/own">o</a><link href="//no.net/">'


def test_distrust_flows_back_and_trust_forward(spark):
    rows = [page(1, "bad.net"), page(2, "spam.com", "bad.net", "BAD.net:80"), page(3, "farm.com", "spam.com"), page(4, "news.com"), (5, "http://good.org/fr/", '<a href="http://news.com/">n</a><a href="http://mixed.com">m</a>'), page(6, "mixed.com", "bad.net", "a.com", "b.com", "c.com", "d.com"), page(6, "mixed.com", "bad.net"), (None, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' as verdict")
    got = {r.page_id: r.verdict for r in u.judge(df, RULES).collect()}
    assert got[1] == "block" and got[2] == "block" and got[3] == "block" and got[4] == "allow" and got[5] == "allow" and got[None] == "allow"
    # a plain power iteration over the same graph
    edges = {("spam.com", "bad.net"): 1, ("farm.com", "spam.com"): 1, ("good.org", "news.com"): 1, ("good.org", "mixed.com"): 1, ("mixed.com", "bad.net"): 2} | {("mixed.com", f"{x}.com"): 1 for x in "abcd"}

    def walk(edges, seeds):
        r = dict.fromkeys(seeds, 1 / len(seeds))
        for _ in range(8):
            new = {s: 0.15 / len(seeds) for s in seeds}
            for (a, b), w in edges.items():
                new[b] = new.get(b, 0) + 0.85 * w / sum(v for (c, _), v in edges.items() if c == a) * r.get(a, 0)
            r = new
        return r

    trust, distrust = walk(edges, ["good.org"]), walk({(b, a): w for (a, b), w in edges.items()}, ["bad.net"])
    assert got[6] == ("block" if distrust["mixed.com"] > trust["mixed.com"] + 1e-9 else "allow")


def test_empty(spark):
    assert u.judge(spark.createDataFrame([], "page_id long, url string, html string"), RULES).count() == 0


@pytest.mark.parametrize("rows", [[], [page(1, "a.net")], [page(1, "a.com", "b.net"), page(2, "b.net", "c.com"), page(3, "c.com")]])
def test_oracle(spark, rows, tmp_path):
    import duckdb

    from textloom.llm.queries import ORACLE_SQL

    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    df.write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    want = sorted(map(str, con.execute(f"select page_id, host, path, rule, verdict from ({ORACLE_SQL['op4_url_filter']})").fetchall()))
    assert sorted(str(tuple(r)) for r in u.judge(df, RULES).collect()) == want


def test_many_rules_by_a_join(spark):
    import random

    r = random.Random(2)
    host = lambda: ".".join(r.choice(["a", "b", "net", "org", "x1"]) for _ in range(r.randrange(1, 4)))
    rules = list({u.Rule(r.choice(["allow", "block"]), host(), "/" + r.choice(["", "a", "ab/", "c/d"])) for _ in range(300)})
    df = spark.createDataFrame([(i, f"http://{host()}/{r.choice(['', 'a', 'ab/c', 'c/d', 'zz'])}") for i in range(300)] + [(1, None), (1, "http://b.net/a")], "page_id long, url string")
    pages = df.select("page_id", u.urls.host(df.url).alias("host"), u.urls.path(df.url).alias("path"))
    rows = lambda d: sorted(str((x.page_id, x.host, x.path, x.rule, x.verdict)) for x in d.collect())
    joined = u.with_rules(pages, rules)
    assert len(rules) > u.CASE_RULES and rows(joined) == rows(u.with_rules(pages, rules, case_rules=1000))
    assert joined.where("rule is not null").count() > 100


def test_walks_until_nothing_changes(spark):
    """Distrust of a seed reaches the end of a chain of 30 hosts, and 10,000 seeds don't wash it out."""
    chain = [page(i, f"c{i}.com", f"c{i + 1}.com") for i in range(30)] + [page(30, "c30.com", "seed.net"), page(31, "seed.net")]
    df = spark.createDataFrame(chain, "page_id long, url string, html string")
    many = spark.range(10_000).selectExpr("id + 1000 as page_id", "concat('http://s', id, '.net/') as url", "'' as html")
    edges = u.host_edges(df.selectExpr("page_id", "split(url, '/')[2] as host", "html"))
    assert u.propagate(edges.selectExpr("dst as src", "src as dst", "weight"), spark.createDataFrame([("seed.net",)], "host string"), u.EXACT).count() == 32
    exact = {r.page_id: r.verdict for r in u.judge(df.unionByName(many), RULES, u.EXACT, margin=1e-6, relative=True).collect()}
    fixed = {r.page_id: r.verdict for r in u.judge(df.unionByName(many), RULES).collect()}
    assert all(exact[i] == "block" for i in range(32)) and fixed[0] == "allow" and fixed[30] == "block"


def test_ports_users_long_html_and_repeated_rows(spark):
    far = '<a href="//x.com/">x</a> ' * 40_000 + '<a href="//spam.com:8080/">s</a>'
    rows = [page(1, "bad.net"), page(2, "spam.com:8080", "bad.net"), page(2, "spam.com:8080", "bad.net"), (3, "http://me@far.com/", far), (4, "http://far.com/other", None)]
    got = [(r.page_id, r.host, r.verdict) for r in u.judge(spark.createDataFrame(rows, "page_id long, url string, html string"), RULES).orderBy("page_id").collect()]
    assert got == [(1, "bad.net", "block"), (2, "spam.com:8080", "block"), (2, "spam.com:8080", "block"), (3, "me@far.com", "block"), (4, "far.com", "block")]
