from usagelens.llm.url_cascade import RULES, Cascade, url_filter


def brute(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, rest = rest[:cut], rest[cut:]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
        path = rest[: min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])]
    best = None
    for action, rule in rules:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[1])):
            best = (action, rule)
    return host, path, best and best[1], best[0] if best else "allow"


URLS = [
    "http://a.org/", "http://example.org/es/1", "https://X.EXAMPLE.org/en/12?q#f", "http://example.org/en/2", "http://q.com/fr/", "http://q.com/de/x", "http://com/de/", "http://xcom/de/", "ftp://b.net",
    None, "", "no scheme", "http://", "http://org", "http://org?x", "http://a.org#y", "a://b://c.org/x", "http://notexample.org/es/", "http://x.org\n/y", "http://" + "s." * 3000 + "org/" + "p" * 9000, "http://a..org/es/", "http://ÉÀ.org/x",
]


def test_against_brute_force(spark):
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(URLS + URLS[:3])], "page_id long, url string, rule string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter(pages, spark.createDataFrame(RULES, "action string, rule string")).collect()}
    assert got == {i: brute(u, RULES) for i, u in enumerate(URLS + URLS[:3])}


def test_empty(spark):
    rules = spark.createDataFrame(RULES, "action string, rule string")
    pages = spark.createDataFrame([(1, "http://a.org/")], "page_id long, url string")
    assert url_filter(pages.limit(0), rules).count() == 0
    assert [r.verdict for r in url_filter(pages, rules.limit(0)).collect()] == ["allow"]


def test_cascade_is_exact_over_its_universe(spark):
    universe = spark.range(20_000).selectExpr("concat('k', id) as key")
    listed = spark.range(0, 20_000, 7).selectExpr("concat('k', id) as key")
    c = Cascade(listed, universe)
    assert len(c.levels) > 1
    from pyspark.sql import functions as F

    assert universe.where(c.has(F.col("key"))).exceptAll(listed).count() == 0
    assert listed.where(~c.has(F.col("key"))).count() == 0
