"""Verdicts against a plain loop over all rules, the index, and addresses."""

import re

from hypothesis import HealthCheck, given, settings, strategies as st

from tracelake.llm import url_filters as u
from tracelake.llm.queries import SITES

RULES = (*SITES, *u.DEFAULT_RULES)


def address(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url[url.index("://") + 3 :]
    host = re.match(r"[^/?#]*", rest)[0]
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    return low, re.match(r"[^?#]*", rest[len(host) :])[0]


def fits(rule, host, path):
    if rule.site:
        own, slash, start = rule.pattern.partition("/")
        return (host == own or host.endswith("." + own)) and (not slash or path.startswith("/" + start))
    pattern = rule.pattern.removeprefix("||")
    edge = "(?:(?<![A-Za-z0-9])|(?![A-Za-z0-9]))"
    body = "".join(edge if c == "^" else ".*" if c == "*" else re.escape(c) for c in pattern)
    return re.search((r"\A(?:[^/]*\.)?" if pattern != rule.pattern else "") + body, host + path, re.DOTALL) is not None


def brute(url, rules, default="allow"):
    host, path = address(url)
    rank = lambda r: (len(r.pattern), r.action, r.pattern)
    sites = [r for r in rules if r.site and fits(r, host, path)]
    others = [r for r in rules if not r.site and fits(r, host, path)]
    if sites:
        best = max(sites, key=rank)
        return host, path, best.pattern, None, best.action
    best = max(others, key=rank, default=None)
    return host, path, None, best.pattern if best else None, best.action if best else default


def check(spark, urls, rules=RULES):
    df = spark.createDataFrame([(i, x, "h", "t") for i, x in enumerate(urls)], "page_id long, url string, host string, token string")
    found = u.judge(df, u.rules_table(spark, rules)).collect()
    assert {r.page_id: (r.host, r.path, r.rule, r.pattern, r.verdict) for r in found} == {i: brute(x, rules) for i, x in enumerate(urls)}
    assert len(found) == len(urls)


URLS = [
    None, "", "no scheme", "://", "http://org", "http://org/", "http://A.ORG/x?y#z", "http://xorg/", "http://example.org/es/1", "http://EXAMPLE.org/ES/1",
    "https://a.b.example.org/en/1", "https://example.org/en/150", "https://example.org/en/2", "https://notexample.org/es/", "http://x.com/fr/", "http://x.com/fr", "http://x.com/de/1?p=/fr/",
    "http://x.com?/de/", "http://org:80/a", "http://u@x.org/a", "a://b://c.org/", "http://the-casino.net/", "http://casinos.net/", "http://x.net/a/xxx", "http://x.net/?xxx", "http://ads.x.net/",
    "http://x.ads.net/a", "http://myads.net/", "http://cheap-x.net/replica", "http://replica.net/cheap", "http://en.wikipedia.org/wiki/poker", "http://en.wikipedia.net/wiki/poker", "http://xn--é.net/Poker/", "http://x.net/poker\n/a", "http://x.net/" + "a/" * 20_000 + "torrent",
]


def test_verdicts(spark):
    check(spark, URLS + URLS[5:9])


def test_odd_rules(spark):
    rules = (u.Rule("net", site=True), u.Rule("b.net", "allow", True), u.Rule("*"), u.Rule("a.b(c", "allow"), u.Rule("^1^"), u.Rule("a*b*c"), u.Rule("||x^"), u.Rule("$1\\"), u.Rule("net/a*", site=True))
    check(spark, [*URLS, "http://b.net/", "http://net", "http://c.network/", "http://k/a.b(c", "http://k/1/2", "http://k/12", "http://k/a1b2c", "http://y.x/1", "http://xx/", "http://k/$1\\", "http://q.net/a*b"], rules)


def test_no_rules_no_rows_and_nulls(spark):
    pages = spark.createDataFrame([(None, "http://casino.net/"), (1, None)], "page_id long, url string")
    none = u.rules_table(spark, RULES).limit(0)
    assert {(r.page_id, r.verdict) for r in u.judge(pages, none, default="block").collect()} == {(None, "block"), (1, "block")}
    odd = spark.createDataFrame([(None, "block", True), ("casino", None, None), ("", "block", None), ("^casino^", "block", None), ("^casino^", "block", None)], "pattern string, action string, site boolean")
    assert sorted((str(r.page_id), r.verdict, r.pattern) for r in u.judge(pages, odd).collect()) == [("1", "allow", None), ("None", "block", "^casino^")]
    assert u.judge(pages.limit(0), odd).count() == 0


def test_rules_are_listed_under_their_rarest_token(spark):
    df = spark.createDataFrame([(f"x.com/{i}/de",) for i in range(9)] + [("y.org/fr",)], "address string").withColumn("tokens", u.tokens(u.F.col("address")))
    ready = u.compiled(u.rules_table(spark, (u.Rule("com/fr/", site=True), u.Rule("com/de/", site=True), u.Rule("*de*"), u.Rule("^zz^-^com^"), u.Rule("example.org/en/1", site=True))))
    assert {r.pattern: r.token for r in u.index(ready, df).collect()} == {"com/fr/": "fr", "com/de/": "com", "*de*": "", "^zz^-^com^": "zz", "example.org/en/1": "example"}


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(st.sampled_from("ab.-/1?A"), max_size=12), max_size=20), st.lists(st.text(st.sampled_from("ab.-/1*^"), min_size=1, max_size=6), max_size=6), st.booleans())
def test_any_rules(spark, rest, patterns, small):
    old, u.SMALL = u.SMALL, u.SMALL if small else 0
    try:
        check(spark, ["http://" + x for x in rest], tuple(u.Rule(("||" if i % 3 == 1 else "") + p, "allow" if i % 2 else "block") for i, p in enumerate(dict.fromkeys(patterns))))
    finally:
        u.SMALL = old
