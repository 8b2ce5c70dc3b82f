"""Results do not change when one key holds half of all rows and joins are split by key size."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from listwright.operators import checks, normalize as nz, queue as q, review, scoring

SETTINGS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "2000",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1000",
}
KEY = ("job_id", "profile_version", "resume_version")


@pytest.fixture(scope="module")
def skewed(spark):
    before = {name: spark.conf.get(name, None) for name in SETTINGS}
    for name, value in SETTINGS.items():
        spark.conf.set(name, value)
    yield
    for name, value in before.items():
        spark.conf.unset(name) if value is None else spark.conf.set(name, value)


@pytest.fixture(scope="module")
def data():
    rng = random.Random(11)
    jobs = [
        (f"j{i}", "hot" if rng.random() < 0.5 else f"c{i % 40}", f"t{i % 7}") for i in range(600)
    ]
    scores = [
        ("j1" if rng.random() < 0.4 else f"j{rng.randrange(700)}", f"p{i}", rng.randint(0, 100),
         rng.randint(0, 100), rng.choice(["named_target", "keyword"]))
        for i in range(3000)
    ]
    return jobs, scores


@pytest.fixture(scope="module")
def frames(spark, data):
    jobs, scores = data
    companies = sorted({c for _, c, _ in jobs})
    return (
        spark.createDataFrame(
            [(j, c, t, [], "u") for j, c, t in jobs],
            "job_id string, company_id string, title string, locations array<string>, url string",
        ).repartition(6),
        spark.createDataFrame(
            [(c, f"Name {c}", f"ats{len(c)}") for c in companies],
            "company_id string, name string, ats_provider string",
        ),
        spark.createDataFrame(
            [(j, p, "r", a, b, "s", t, 1) for j, p, a, b, t in scores],
            "job_id string, profile_version string, resume_version string, "
            "qualification_score int, fit_score int, summary string, tier string, created_at long",
        ).repartition(6),
    )


def test_review_queries(skewed, data, frames):
    jobs, scores = data
    company = {j: (f"Name {c}", t, f"ats{len(c)}") for j, c, t in jobs}
    joined = [(*company[j], j, p, a + b, t) for j, p, a, b, t in scores if j in company]
    frame = review.review_columns(review.score_view(frames[2], frames[0], frames[1]))
    assert frame.count() == len(joined)
    best = {}
    for name, _, _, j, p, total, tier in joined:
        if tier == "named_target":
            best[name] = min(best.get(name, (1, "", "")), (-total, j, p))
    got = {
        r.company: (-r.combined, r.job_id, r.profile_version)
        for r in review.best_per_company(frame).collect()
    }
    assert got == best
    pairs = {(name, title): ats for name, title, ats, *_ in joined}
    counts = {r.ats: r.jobs for r in review.provider_counts(frame).collect()}
    assert counts == Counter(pairs.values())
    top = sorted((-total, j, p) for _, _, _, j, p, total, _ in joined)[:20]
    assert [(-r.combined, r.job_id, r.profile_version)
            for r in review.top_combined(frame).collect()] == top


def test_exclusion_and_insertion(skewed, data, frames):
    jobs, scores = data
    done = frames[2].select("job_id", F.lit("p").alias("profile_version"), "resume_version")
    left = {r.job_id for r in q.unscored(frames[0], done, "p", "r").collect()}
    assert left == {j for j, _, _ in jobs} - {s[0] for s in scores}
    batch = frames[2].select("job_id", "profile_version", "fit_score")
    stored = frames[0].filter("title = 't1'").select("job_id")
    added = scoring.insert_or_ignore(stored, batch, ("job_id",), F.col("profile_version"))
    have = {j for j, _, t in jobs if t == "t1"}
    first = {}
    for j, p, _, fit, _ in scores:
        if j not in have:
            first[j] = min(first.get(j, ("z", 0)), (p, fit))
    assert {r.job_id: (r.profile_version, r.fit_score) for r in added.collect()} == first
    orphans = checks.orphan_count(frames[2], "job_id", frames[0], "job_id").first().orphans
    assert orphans == sum(s[0] not in {j for j, _, _ in jobs} for s in scores)


def test_copies_across_sources(skewed, data, frames):
    jobs, _ = data
    sources = defaultdict(set)
    for _, c, t in jobs:
        sources[c].add(t)
    got = nz.same_content_across_sources(frames[0], "company_id", "title").collect()
    assert {r.company_id: r.sources for r in got} == {
        c: ",".join(sorted(s)) for c, s in sources.items() if len(s) > 1
    }
    assert {r.company_id: r.copies for r in got} == {
        c: n for c, n in Counter(c for _, c, _ in jobs).items() if len(sources[c]) > 1
    }
