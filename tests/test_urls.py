from pyspark.sql import functions as F

from listwright.functions import urls

CASES = {
    "https://boards.greenhouse.io/acme/jobs/1": ("greenhouse", "acme"),
    "https://job-boards.greenhouse.io/": ("greenhouse", None),
    "https://user@JOBS.lever.co:443/Acme/9?x=1#f": ("lever", "Acme"),
    "https://jobs.ashbyhq.com/a-b/9": ("ashby", "a-b"),
    "https://Acme.wd5.myworkdayjobs.com/x": ("workday", "acme"),
    "https://careers-acme.icims.com/jobs": ("icims", "acme"),
    "https://careers-careers-acme.icims.com/": ("icims", "acme"),
    "https://foo_bar.icims.com/jobs": ("icims", "foo_bar"),
    "https://careers.smartrecruiters.com/Acme": ("smartrecruiters", "Acme"),
    "https://jobs.smartrecruiters.com/Acme/1": ("smartrecruiters", "Acme"),
    "https://smartrecruiters.com/Acme": (None, None),
    "https://acme.taleo.net/x": ("taleo", "acme"),
    "https://sjobs.brassring.com/x": ("brassring", None),
    "https://jobs.jobvite.com/acme;v=1": ("jobvite", "acme"),
    "https://acme.recruitee.com/o/x": ("recruitee", "acme"),
    "https://apply.workable.com/acme/": ("workable", "acme"),
    "https://myworkdayjobs.com/x": (None, None),
    "boards.greenhouse.io/acme": (None, None),
    "//boards.greenhouse.io/acme": ("greenhouse", "acme"),
    "  https://jobs.lever.co/acme": ("lever", "acme"),
    "https://jobs.le\nver.co/acme": ("lever", "acme"),
    "https://a@b@jobs.lever.co/acme": ("lever", "acme"),
    "https://jobs.lever.co?x=/acme": ("lever", None),
    "https://jobs.lever.co/a b/c": ("lever", "a b"),
    "https://jobs.lever.co//a%20b//c": ("lever", "a%20b"),
    "https://jobs.lever.co/a;p/b;q": ("lever", "a;p"),
    "https://[x].icims.com/": (None, None),
    "https://evil.com/boards.greenhouse.io/acme": (None, None),
    "https://boards.greenhouse.io.evil.com/acme": (None, None),
    "": (None, None),
    None: (None, None),
    "not a url": (None, None),
}


def test_provider_and_token(apply):
    rows = [(u,) for u in CASES]
    providers = apply(lambda u: urls.provider_of(urls.host(u)), rows, "u string")
    tokens = apply(
        lambda u: urls.token_of(urls.host(u), urls.path_segments(u)), rows, "u string"
    )
    assert dict(zip(CASES, zip(providers, tokens))) == CASES


def test_host_and_segments_without_scheme(apply):
    rows = [("a.example/b/c",), ("ftp://X.example:21/p;q/r;s?t#u",)]
    assert apply(urls.host, rows, "u string") == ["", "x.example"]
    assert apply(urls.path_segments, rows, "u string") == [["a.example", "b", "c"], ["p;q", "r"]]


def test_own_rule_table(apply):
    rules = (("shop", "suffix", ".shop.test", "label"), ("wiki", "exact", "wiki.test", "path"))
    rows = [("http://a.shop.test/x",), ("http://wiki.test/Page",), ("http://x.wiki.test/Page",)]
    assert apply(lambda u: urls.provider_of(urls.host(u), rules), rows, "u string") == [
        "shop", "wiki", None,
    ]
    assert apply(
        lambda u: urls.token_of(urls.host(u), urls.path_segments(u), rules), rows, "u string"
    ) == ["a", "Page", None]


def test_no_python_in_the_plan(spark):
    frame = spark.createDataFrame([("http://a.b/c",)], "u string")
    plan = frame.select(urls.provider_of(urls.host(F.col("u"))))._jdf.queryExecution().toString()
    assert "Python" not in plan
