import pytest
from pyspark.sql import functions as F

from listwright.llm import urls

RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]
URLS = [
    ("http://example.com/en/1", "example.com", "/en/1", "example.com/en/", "block"),
    ("https://a.WWW.Example.com/en/?x", "a.www.example.com", "/en/", "www.example.com/en/", "allow"),
    ("https://wwwexample.com/en/", "wwwexample.com", "/en/", "com/", "allow"),
    ("http://example.com/en", "example.com", "/en", "com/", "allow"),
    ("http://example.com", "example.com", "", None, "allow"),
    ("http://x.net/es/fr/9#t", "x.net", "/es/fr/9", "net/es/", "block"),
    ("http://net/fr/", "net", "/fr/", "net/fr/", "block"),
    ("http://x.net/FR/", "x.net", "/FR/", None, "allow"),
    ("http://bad.org/any/page", "bad.org", "/any/page", None, "block"),
    ("http://one.org/page.html?q", "one.org", "/page.html", None, "block"),
    ("http://one.org/page.html/more", "one.org", "/page.html/more", None, "allow"),
    ("http://bad.com/x", "bad.com", "/x", "com/", "allow"),
    ("http:///en/", "", "/en/", None, "allow"),
    ("x://a://b/c", "a:", "//b/c", None, "allow"),
    ("no scheme", "", "", None, "allow"), ("", "", "", None, "allow"), (None, "", "", None, "allow"),
]


@pytest.mark.parametrize("n_blocks", [None, urls.BROADCAST_BLOCKS, 1, 2 * urls.BROADCAST_BLOCKS])
def test_verdicts(spark, n_blocks):
    pages = spark.createDataFrame([(i, u[0]) for i, u in enumerate(URLS)] + [(0, URLS[0][0]), (None, URLS[0][0])], "page_id long, url string")
    rules = spark.createDataFrame(RULES + [("com/", "allow"), (None, "block"), ("org/", None)], "key string, verdict string")
    blocked = spark.createDataFrame([("bad.org/",), ("one.org/page.html",), ("bad.com/",), (None,)], "key string")
    found = urls.judged(pages, rules, blocked, n_blocks).collect()
    assert len(found) == len(URLS) + 2
    for r in found:
        assert tuple(r)[1:] == URLS[r["page_id"] or 0][1:]


def test_the_filter_is_bounded_and_has_every_listed_key(spark):
    listed = spark.range(3000).select(F.concat(F.lit("h"), "id", F.lit(".org/")).alias("key"))
    bits = urls.bloom(listed, 16)
    assert bits.count() <= 16
    probe = listed.select("key", urls._block(F.col("key"), 16).alias("block"), *(m.alias(f"m{n}") for n, m in enumerate(urls._masks(F.col("key")))))
    passed = probe.join(bits, "block").filter(" and ".join(f"(b{n} & m{n}) = m{n}" for n in range(urls.WORDS)))
    assert passed.count() == 3000
    other = probe.filter("false").union(probe.withColumn("m0", F.lit(-1).cast("long")))
    assert other.join(urls.bloom(listed, 1 << 15), "block").filter("(b0 & m0) = m0").count() == 0


def test_both_verdicts_block_and_empty_tables(spark):
    pages = spark.createDataFrame([(1, "http://a.org/x")], "page_id long, url string")
    rules = spark.createDataFrame([("a.org/", "allow"), ("a.org/", "block")], "key string, verdict string")
    assert urls.judged(pages, rules).first()["verdict"] == "block"
    assert urls.judged(pages, rules.limit(0)).first()["verdict"] == "allow"
    assert urls.judged(pages.limit(0), rules).count() == 0


def test_very_long_urls_and_clashing_columns(spark):
    import time

    folders = "en/" * 300_000
    pages = [(1, f"http://example.com/{folders}"), (2, f"http://{'a.' * 300_000}example.com/en/"), (3, "http://example.com/" + "x" * 1_000_000),
             (4, f"http://{'b.' * 2000}example.com/{'en/' * 2000}")]
    frame = spark.createDataFrame(pages, "page_id long, url string")
    for name in ("key", "verdict", "rank", "block", "m0", "b0", "host", "mark", "hit_id"):
        frame = frame.withColumn(name, F.lit(name))
    rules = spark.createDataFrame(RULES, "key string, verdict string")
    start = time.time()
    found = {r["page_id"]: (r["rule"], r["verdict"]) for r in urls.judged(frame, rules).collect()}
    assert found == {1: ("example.com/en/", "block"), 2: ("example.com/en/", "block"), 3: ("com/", "allow"), 4: ("example.com/en/", "block")}
    assert time.time() - start < 60


def test_pages_ask_only_for_lengths_that_the_list_has(spark):
    listed = spark.createDataFrame([("com/",), ("a.b.org/x/y/",), ("c.net/page",)], "key string")
    asked, size = urls.lengths(listed)
    assert size == 3 and asked == urls.Lengths((1, 2, 3), (1, 3), True)
    row = spark.createDataFrame([("w.a.b.org", "/x/y/z/page")], "host string, path string").select(
        urls.keys(F.col("host"), F.col("path"), asked).alias("keys")).first()
    hosts, paths = ["org", "b.org", "a.b.org"], ["/", "/x/y/", "/x/y/z/page"]
    assert sorted(k["key"] for k in row["keys"]) == sorted(h + p for h in hosts for p in paths)


def test_a_list_of_many_urls(spark):
    rules = spark.range(20000).select(F.concat(F.lit("h"), "id", F.lit(".org/")).alias("key"), F.lit("block").alias("verdict"))
    pages = spark.range(1000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://www.h"), F.col("id") * 37, F.lit(".org/x")).alias("url"))
    found = urls.judged(pages, rules).groupBy("verdict").count().collect()
    assert {r["verdict"]: r["count"] for r in found} == {"block": 541, "allow": 459}
