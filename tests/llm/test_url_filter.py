from pyspark.sql import functions as F

from fieldlens.llm import url_filter
from fieldlens.llm.queries import URL_RULES

RULES = "host string, path string, verdict string"


def brute(url, rules):
    if not url or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, rest = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
    path = rest[: min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
    fits = [(len(h + p), len(h), v, h + p) for h, p, v in rules if h is not None and (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, max(fits)[3], max(fits)[2]) if fits else (host, path, None, "allow")


URLS = [None, "", "example.net/en/", "http://example.net/en/x", "HTTP://WWW.Example.NET/en/x?q#f", "http://a.b.example.com/de/1", "http://example.com/de", "http://org/fr/", "https://x.org/fr/9#t", "http://net", "http://net/", "http://subnet/", "http://x.net?a=http://y.org/fr/", "ftp://é.net/ä", "://", "http:///p", "http://xn..net/", "http://" + "a." * 300 + "net/" + "p/" * 2000]


def check(spark, urls, rules):
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("clash"))
    got = url_filter.judge_urls(pages, spark.createDataFrame(rules, RULES)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str((i, *brute(u, rules))) for i, u in enumerate(urls))


def test_contract_rules(spark):
    check(spark, [*URLS, *URLS], URL_RULES)


def test_many_rules_ties_and_false_positives(spark):
    rules = [(f"h{i}.example.org", f"/{i % 3}/", "block" if i % 2 else "allow") for i in range(300)] + [("example.org", "/1/", "allow"), ("example.org", "/1/", "block")]
    check(spark, [f"http://www.h{i}.example.org/{i % 5}/x" for i in range(600)] + URLS, rules)


def test_no_rules_no_pages(spark):
    check(spark, URLS, [(None, "/", "block")])
    assert url_filter.judge_urls(spark.createDataFrame([], "page_id long, url string"), spark.createDataFrame(URL_RULES, RULES)).count() == 0


def test_plan_has_no_python(spark):
    pages = spark.createDataFrame([(1, "http://x.net/")], "page_id long, url string")
    plan = url_filter.judge_urls(pages, spark.createDataFrame(URL_RULES, RULES))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
