"""URL rules against a direct reading of them."""

from __future__ import annotations

import random

from quernstone.llm import url_rules


def judged(url, rules, default="allow"):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        end = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
        host, path = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end]), rest[end:]
        path = path[: min((path.find(c) for c in "?#" if c in path), default=len(path))]
    fits = []
    for rule, verdict in rules:
        h, _, p = rule.partition("/")
        p = "/" + p if "/" in rule else ""
        if h and host and (host == h or host.endswith("." + h)) and path.startswith(p):
            fits.append((len(rule), len(h), rule, verdict))
    best = max(fits, default=None)
    return host, path, best[2] if best else None, best[3] if best else default


def test_rules_and_odd_urls(spark):
    rng = random.Random(5)
    urls = [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/7?x", "http://example.com/en/712#a", "https://a.b.example.net/de/8", "http://net/de/", "http://xnet/de/1", "ftp://example.org/es/", "http://example.com", "http://com/en/", "http://u@example.com:80/en/", "a://b://c/en/", "http://Ünet/de/1", "http://x.net/de/\n8"]
    urls += [f"http://{rng.choice(['', 'www.', 'a.b.'])}{rng.choice(['example.com', 'example.net', 'org', 'net'])}/{rng.choice(['en', 'de', 'es'])}/{rng.randrange(100)}" for _ in range(200)]
    rows = [(i, u, "x") for i, u in enumerate(urls)] + [(3, urls[3], "again"), (None, "http://net/de/", "y")]
    df = spark.createDataFrame(rows, "page_id long, url string, rule string")
    out = url_rules.judge(df, url_rules.rule_table(spark)).collect()
    expected = sorted(str((i, *judged(u, url_rules.RULES))) for i, u, _ in rows)
    assert sorted(str(tuple(r)) for r in out) == expected


def test_no_rules_and_no_pages(spark):
    df = spark.createDataFrame([(1, "http://a/b")], "page_id long, url string")
    none = url_rules.rule_table(spark, ())
    assert [tuple(r) for r in url_rules.judge(df, none, default="block").collect()] == [(1, "a", "/b", None, "block")]
    assert url_rules.judge(df.limit(0), url_rules.rule_table(spark)).collect() == []


def test_precedence_ties(spark):
    rules = (("b.c/x", "allow"), ("c/xyz", "block"), ("/none", "block"), ("c", "block"))
    df = spark.createDataFrame([(1, "http://b.c/xyz"), (2, "http://c/"), (3, "http://d/none")], "page_id long, url string")
    out = {r.page_id: (r.rule, r.verdict) for r in url_rules.judge(df, url_rules.rule_table(spark, rules)).collect()}
    assert out == {1: ("b.c/x", "allow"), 2: ("c", "block"), 3: (None, "allow")}
