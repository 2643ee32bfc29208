import pytest

from emberlog.llm.op10_url_filter import RULES, filter_urls, rule_table

URLS = [
    (1, "http://A.Example.com/en/x?q#f", "a.example.com", "/en/x", "example.com/en/", "block"), (2, "https://www.example.com/en/", "www.example.com", "/en/", "www.example.com/en/", "allow"), (3, None, "", "", None, "allow"), (4, "", "", "", None, "allow"), (5, "no scheme.com/en/", "", "", None, "allow"),
    (6, "http://x.net/es/1", "x.net", "/es/1", "net/es/", "block"), (7, "http://x.net/es", "x.net", "/es", None, "allow"), (8, "http://example.com", "example.com", "", None, "allow"), (9, "http://notexample.com/en/", "notexample.com", "/en/", "com/", "allow"), (10, "http://deep.www.example.com/en/a://b", "deep.www.example.com", "/en/a://b", "www.example.com/en/", "allow"),
    (10, "http://deep.www.example.com/en/a://b", "deep.www.example.com", "/en/a://b", "www.example.com/en/", "allow"), (11, "http://x.net?/es/", "x.net", "", None, "allow"), (12, "://net/fr/", "net", "/fr/", "net/fr/", "block"), (13, "http://é.com/", "é.com", "/", "com/", "allow"), (14, "http://x.com/" + "y/" * 3000, "x.com", "/" + "y/" * 3000, "com/", "allow"),
]


@pytest.mark.parametrize("shapes", [32, 0])
def test_rules(spark, shapes):
    pages = spark.createDataFrame([(i, u, "x", 1) for i, u, *_ in URLS], "page_id long, url string, host string, verdict int")
    got = sorted(tuple(map(str, (r.page_id, r.url, r.host, r.path, r["rule"], r.verdict))) for r in filter_urls(pages, rule_table(spark, RULES), most_shapes=shapes).collect())
    assert got == sorted(tuple(map(str, u)) for u in URLS)
    assert filter_urls(pages.limit(0), rule_table(spark, RULES), most_shapes=shapes).count() == 0
    assert filter_urls(pages, rule_table(spark, RULES).limit(0), most_shapes=shapes).where("verdict != 'allow' or rule is not null").count() == 0
    odd = rule_table(spark, [*RULES, (None, "/", "block"), ("x.net", "/es/1", "allow"), ("X.NET", "/es/1", "block")])
    assert {r.page_id: (r["rule"], r.verdict) for r in filter_urls(pages, odd, most_shapes=shapes).collect()}[6] == ("x.net/es/1", "block")
