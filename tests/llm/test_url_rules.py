import pytest

from chainalerts.llm import url_rules as R

URLS = [
    (1, None, None), (2, "", None), (3, "no scheme", None), (4, "HTTP://Shop.EXAMPLE.net/en/1?x", "example.net/en/"),
    (5, "http://example.net/fr/", "net/"), (6, "http://myexample.net/en/", "net/"), (7, "http://net/", "net/"),
    (8, "http://a.net", None), (9, "http://a.org/fr/", "org/fr/"), (10, "http://a.org/frx", None),
    (11, "https://example.com/de/#a", "example.com/de/"), (12, "x://y://example.com/de/", None),
    (13, "http://example.com/DE/", None), (13, "http://example.com/DE/", None), (None, "http://b.net/x", "net/"),
    (14, "http://www.cheap-pills.example.com/en/", None), (15, "http://a.com/cheap-pills.html", None),
    (16, "http://Ünet.net/\n", "net/"),
]


def test_rules(spark):
    pages = spark.createDataFrame([(a, b, "x") for a, b, _ in URLS], "page_id long, url string, rule string")
    got = [(r["page_id"], r["rule"], r["verdict"]) for r in R.judge(pages).collect()]
    verdict = {"net/": "block", "example.net/en/": "allow", "org/fr/": "allow", "example.com/de/": "block"}
    want = [(a, rule, verdict.get(rule, "block" if a == 14 else "allow")) for a, _, rule in URLS]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_index_uses_the_rarest_token():
    rules = [R.Rule("block", "net", "/"), R.Rule("allow", "example.net", "/en/"), R.Rule("block", pattern=".*")]
    assert R.rule_index(rules, {"net": 9, "example": 2, "en": 5}) == {"net": [0], "example": [1], "": [2]}
    # The last token of a prefix may go on in the url.
    assert R.Rule("block", "net", "/ab/c").tokens() == {"net", "ab"}


def test_empty_and_bound(spark):
    assert R.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0
    with pytest.raises(ValueError):
        R.judge(spark.createDataFrame([], "page_id long, url string"), R.BASE_RULES * 30_000)
