import pytest

from ledgerfold.llm import urlfilter
from ledgerfold.llm.queries import URL_RULES

URLS = [
    (1, "http://x.net/", ("x.net", "/", "net/", "block")),
    (2, "http://a.example.NET/en/x?y#z", ("a.example.net", "/en/x", "example.net/en/", "allow")),
    (3, "https://example.net/en", ("example.net", "/en", "net/", "block")),
    (4, "https://example.com/de/1", ("example.com", "/de/1", "example.com/de/", "block")),
    (5, "https://notexample.com/de/1", ("notexample.com", "/de/1", None, "allow")),
    (6, "https://a.b.org/fr/?q", ("a.b.org", "/fr/", "org/fr/", "allow")),
    (7, "https://org#x/fr/", ("org", "", None, "allow")),
    (8, None, ("", "", None, "allow")),
    (9, "", ("", "", None, "allow")),
    (10, "no scheme net/", ("", "", None, "allow")),
    (11, "ftp://ÉX.net/a://b", ("Éx.net", "/a://b", "net/", "block")),
    (12, "http://net", ("net", "", None, "allow")),
    (13, "http://x.net:80/", ("x.net:80", "/", None, "allow")),
    (14, "http://" + "a." * 3000 + "net/" + "p" * 9000, ("a." * 3000 + "net", "/" + "p" * 9000, "net/", "block")),
    (15, "http://a\nb.net/c\nd", ("a\nb.net", "/c\nd", "net/", "block")),
    (None, "http://x.net/", ("x.net", "/", "net/", "block")),
    (1, "http://x.net/", ("x.net", "/", "net/", "block")),
]


@pytest.mark.parametrize(("limit", "joins"), [(urlfilter.BROADCAST_RULES, urlfilter.MAX_JOINS), (urlfilter.BROADCAST_RULES, 0), (0, 0)])
def test_rules(spark, limit, joins):
    pages = spark.createDataFrame([(i, u, "h", 0, "r") for i, u, _ in URLS], "page_id long, url string, html string, row int, rule string")
    out = urlfilter.filter_urls(pages, urlfilter.rule_table(spark, URL_RULES), broadcast_rules=limit, max_joins=joins).collect()
    key = lambda t: str(t)
    assert sorted([(r.page_id, r.host, r.path, r.rule, r.verdict) for r in out], key=key) == sorted([(i, *w) for i, _, w in URLS], key=key)
    plan = urlfilter.filter_urls(pages, urlfilter.rule_table(spark, URL_RULES), broadcast_rules=limit, max_joins=joins)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("joins", [urlfilter.MAX_JOINS, 0])
def test_longest_rule_of_any_shape(spark, joins):
    rules = [("a.com", "block"), ("a.com/x", "allow"), ("b.a.com/", "block"), ("a.com/xy/z", "block"), ("a.com/xy/z", "allow"), (None, "block")]
    pages = spark.createDataFrame([(1, "h://a.com"), (2, "h://c.a.com/xq"), (3, "h://b.a.com/xq"), (4, "h://a.com/xy/zz"), (5, "h://a.co/x")], "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in urlfilter.filter_urls(pages, urlfilter.rule_table(spark, rules), max_joins=joins).collect()}
    assert got == {1: ("a.com", "block"), 2: ("a.com/x", "allow"), 3: ("b.a.com/", "block"), 4: ("a.com/xy/z", "allow"), 5: (None, "allow")}


def test_rules_whose_short_digests_are_equal(spark, monkeypatch):
    """The join compares short prefixes alone; the whole digest tells rules that share one."""
    monkeypatch.setattr(urlfilter, "PREFIX_DIGITS", 1)
    rules = [(f"h{i}.com/", "block" if i % 2 else "allow") for i in range(60)]
    pages = spark.createDataFrame([(i, f"http://h{i}.com/x") for i in range(70)], "page_id long, url string")
    for joins in (urlfilter.MAX_JOINS, 0):
        out = urlfilter.filter_urls(pages, urlfilter.rule_table(spark, rules), max_joins=joins).collect()
        assert {r.page_id: r.rule for r in out} == {i: f"h{i}.com/" if i < 60 else None for i in range(70)} and len(out) == 70


def test_empty(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    assert urlfilter.filter_urls(pages, urlfilter.rule_table(spark, URL_RULES)).collect() == []
    one = spark.createDataFrame([(1, "http://x.net/")], "page_id long, url string")
    assert urlfilter.filter_urls(one, urlfilter.rule_table(spark, [])).first().verdict == "allow"
