import random

from lodestone.llm import url_filter as U
from lodestone.llm.components import connected_components
from lodestone.session import Scratch

from .brute import roots


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x") for i, (u, h) in enumerate(rows)], "page_id long, url string, html string, host string")


def judged(spark, rows, **more):
    return {r.page_id: r for r in U.judge_urls(pages(spark, rows), **more).collect()}


def test_rules_and_parts(spark):
    rows = [
        ("https://WWW.Example.com/en/x", ""), ("https://a.example.com/en/x?q#f", ""), ("https://example.com/en", ""), ("http://x.net/es/1", ""), ("http://x.net/EN/1", ""),
        ("http://example.com", ""), ("http://example.com?x=/en/", ""), (None, None), ("no scheme", ""), ("", ""), ("http://notexample.com/en/", ""), ("ftp://net/fr/", ""),
    ]
    got = judged(spark, rows)
    assert [(got[i].host, got[i].path, got[i].rule, got[i].verdict) for i in range(len(rows))] == [
        ("www.example.com", "/en/x", "www.example.com/en/", "allow"), ("a.example.com", "/en/x", "example.com/en/", "block"), ("example.com", "/en", "com/", "allow"),
        ("x.net", "/es/1", "net/es/", "block"), ("x.net", "/EN/1", None, "allow"), ("example.com", "", None, "allow"), ("example.com", "", None, "allow"),
        ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("notexample.com", "/en/", "com/", "allow"), ("net", "/fr/", "net/fr/", "block"),
    ]


def test_blocks_reach_aliases_and_allows_stay(spark):
    link = lambda u: f'<html><LINK  rel="canonical" class=a href="{u}"></html>'
    refresh = lambda u: f"<meta http-equiv='refresh' content='0; url={u}'>"
    rows = [
        ("http://a.org/1", link("http://b.org/2")),
        ("http://b.org/2#top", refresh("/3")),
        ("http://b.org/3", link("//x.net/es/bad")),
        ("http://x.com/ok", link("http://b.org/3")),
        ("http://lone.org/", link("http://lone.org/")),
        ("http://q.org/p?a=1", "<link href='http://r.org/t?x=1&amp;y=2' rel=canonical>"),
        ("http://r.org/t?x=1&y=2", "<link rel='stylesheet' href='http://x.net/es/bad'>"),
        ("http://c.org/d/e", link("f")),
        ("http://c.org/d/f", None),
        ("http://d.org/1", link("mailto:x@y")),
    ]
    got = judged(spark, rows, redirects=spark.createDataFrame([("http://r.org/t?x=1&y=2", "http://x.net/fr/z"), (None, "http://x")], "source string, target string"))
    assert {i: r.verdict for i, r in got.items()} == {0: "block", 1: "block", 2: "block", 3: "allow", 4: "allow", 5: "block", 6: "block", 7: "allow", 8: "allow", 9: "allow"}
    assert got[3].decided_by == "rule" and got[0].decided_by == "alias" and got[4].decided_by == "default"


def test_many_rules_are_joined(spark):
    rules = U.RULES + [(f"h{i}.org", "/", "block") for i in range(U.INLINE_RULES)]
    rows = [("http://a.h7.org/x", ""), ("https://www.example.com/en/x", ""), ("http://none.org/", ""), ("http://x.net/es/1", ""), (None, None)]
    a, b = judged(spark, rows, rules=rules), judged(spark, rows)
    assert a[0].verdict == "block" and a[0].rule == "h7.org/"
    assert all((a[i].rule, a[i].verdict) == (b[i].rule, b[i].verdict) for i in range(1, 5))
    assert judged(spark, rows, rules=[])[1].rule is None
    assert U.judge_urls(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_components_against_union_find(spark):
    rng = random.Random(2)
    for n, m in ((60, 50), (300, 280), (40, 400)):
        links = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] + [(i, i + 1) for i in range(1000, 1040)] + [(2000, k) for k in range(2001, 2100)]
        want = roots({x for e in links if e[0] != e[1] for x in e}, links)
        got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "u long, v long"), Scratch(spark, "t")).collect()}
        assert got == want
    assert connected_components(spark.createDataFrame([(1, 1), (None, 2)], "u long, v long"), Scratch(spark, "t")).collect() == []
