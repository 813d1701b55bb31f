from urllib.parse import urlsplit

from pyspark.sql import functions as F

from fumble.llm import url_filter as U

URLS = [
    None, "", "nothing", "http://", "http:///x", "HTTP://A.Example.ORG/es/x?q=1#f", "https://example.org/en/12", "https://example.org/en/2", "http://notexample.org/es/",
    "http://x.com/fr/1", "http://x.com/de/1", "http://x.com/De/1", "http://com/fr/", "http://x.org", "http://x.org?a=/", "http://x.org/", "ftp://www.z.net/p/?ref=1&b=2", "http://z.net/p?b=2&utm_source=q",
    "http://m.z.net:80/p?b=2#top", "http://z.net/p?b=3", "a://b://c/d", "http://x.example.com/de/é", "http://line\nbreak.net/p",
]


def parts(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, rest = rest[:cut], rest[cut:]
    cut = min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), rest[:cut]


def brute(url, listed):
    h, p = parts(url)
    fit = [r for r in U.RULES if (h == r[0] or h.endswith("." + r[0])) and p.startswith(r[1])]
    best = max(fit, key=lambda r: len(r[0] + r[1]), default=None)
    return h, p, best and best[0] + best[1], best[2] if best else ("block" if listed else "allow")


def pages(spark, urls):
    return spark.createDataFrame([(i, u) for i, u in enumerate(urls)] * 2, "page_id long, url string")


def test_rules_and_parts_equal_brute_force(spark):
    listed = spark.createDataFrame([("http://z.net/p?b=2",), (None,), ("nothing",)], "url string")
    df = pages(spark, URLS).select("*", *[F.lit(1).alias(c) for c in ("block", "bits", "mask", "host", "rule", "canonical", "on_list")])
    got = sorted(map(tuple, U.url_filter(df, listed).select("page_id", "host", "path", "rule", "verdict").collect()))
    on = {16, 17, 18}
    assert got == sorted((i, *brute(u, i in on)) for i, u in enumerate(URLS) for _ in range(2))


def test_exact_join_removes_what_a_crowded_filter_lets_through(spark):
    urls = [f"http://h{i}.net/p{i}" for i in range(400)]
    listed = spark.createDataFrame([(u,) for u in urls[:150]], "url string")
    names = listed.select(U.canonical(F.col("url")).alias("canonical"))
    assert U.bloom_table(names, 4).count() <= 4
    for blocks in (1, 4, U.BLOCKS):
        got = U.url_filter(pages(spark, urls), listed, blocks=blocks).filter("verdict = 'block'").select("page_id").distinct().collect()
        assert {r[0] for r in got} == set(range(150))


def test_empty_tables(spark):
    none = spark.createDataFrame([], "url string")
    assert U.url_filter(pages(spark, []), none).count() == 0
    assert {r.verdict for r in U.url_filter(pages(spark, ["http://a.net/x"]), none).collect()} == {"allow"}


def test_native(spark):
    plan = U.url_filter(pages(spark, URLS), pages(spark, URLS).select("url"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and urlsplit("http://a/b").path == "/b"
