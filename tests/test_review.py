import pytest
from pyspark.sql import functions as F

from listwright.operators import review

KEY = ("job_id", "profile_version", "resume_version")


@pytest.fixture(scope="module")
def star(spark):
    jobs = spark.createDataFrame(
        [("j1", "c1", "Data", ["NYC", "SF"], "u1"), ("j2", "c1", "Ops", [], "u2"),
         ("j3", "c2", "Data", None, "u3"), ("j4", "c9", "Lost", [], "u4")],
        "job_id string, company_id string, title string, locations array<string>, url string",
    )
    companies = spark.createDataFrame(
        [("c1", "Acme", None), ("c2", "Bolt", "lever"), ("c3", "Idle", "")],
        "company_id string, name string, ats_provider string",
    )
    rows = [
        ("j1", "p1", 100, 0, "named_target", 1), ("j1", "p2", 39, 61, "named_target", 2),
        ("j2", "p1", 40, 60, "named_target", 3), ("j3", "p1", 99, 100, "keyword", 4),
        ("j3", "p2", 0, 9, "named_target", 5), ("j2", "p2", 10, 50, "skip", 6),
        ("j9", "p1", 50, 50, "skip", 7),
    ]
    scores = spark.createDataFrame(
        [(j, p, "r", q, f, None if q == 0 else "s", t, at) for j, p, q, f, t, at in rows],
        "job_id string, profile_version string, resume_version string, qualification_score int, "
        "fit_score int, summary string, tier string, created_at long",
    )
    return scores, jobs, companies


@pytest.fixture(scope="module")
def frame(star):
    return star[0], review.review_columns(review.score_view(*star)), star[1]


def test_view_is_an_inner_join_with_defaults(frame):
    _, rows, _ = frame
    got = {(r.job_id, r.profile_version): r for r in rows.collect()}
    assert len(got) == 6 and ("j9", "p1") not in got
    assert got["j1", "p1"].locations == "NYC, SF" and got["j1", "p1"].ats == "unknown"
    assert got["j2", "p1"].locations == "—" and got["j3", "p1"].locations == "—"
    assert got["j3", "p2"].summary == "" and got["j3", "p1"].combined == 199


def test_top_lists(frame):
    _, rows, _ = frame
    assert [(r.job_id, r.profile_version) for r in review.top_targets(rows).collect()] == [
        ("j3", "p1"), ("j1", "p1"), ("j2", "p1"),
    ]
    assert [r.combined for r in review.top_combined(rows, 2).collect()] == [199, 100]


def test_top_lists_are_the_same_when_ranked_before_wide_columns(star, frame):
    _, rows, _ = frame
    thin = review.rankable(*star)
    assert thin.count() == 6 and "j9" not in {r.job_id for r in thin.collect()}
    for top in (review.top_targets, review.top_combined):
        assert review.described(top(thin), *star).collect() == top(rows).collect()
    assert review.described(review.top_combined(thin, 1), *star).first().title == "Data"
    assert review.described(review.top_combined(thin, 0), *star).count() == 0


def test_providers_of_scored_listings(star, frame):
    listings = review.scored_listings(*star)
    assert sorted(r.job_id for r in listings.collect()) == ["j1", "j2", "j3"]
    _, rows, _ = frame
    assert review.provider_counts(listings, ("job_id",)).collect() == review.provider_counts(rows).collect()


def test_best_per_company_breaks_ties_by_key(frame):
    _, rows, _ = frame
    best = [(r.company, r.job_id, r.profile_version) for r in review.best_per_company(rows).collect()]
    assert best == [("Acme", "j1", "p1"), ("Bolt", "j3", "p2")]


def test_kpis(frame, spark):
    scores, _, jobs = frame
    row = review.kpis(jobs.withColumn("active", F.col("job_id") != "j1"), scores).first()
    assert (row.total_jobs, row.total_active, row.total_scored, row.last_refreshed) == (4, 3, 7, 7)
    empty = review.kpis(jobs.limit(0).withColumn("active", F.lit(True)), scores.limit(0)).first()
    assert (empty.total_jobs, empty.total_scored, empty.last_refreshed) == (0, 0, None)


def test_histogram_drops_100_and_negatives_unless_closed(spark):
    scores = spark.createDataFrame(
        [(s, s) for s in (0, 9, 10, 39, 40, 99, 100, -5, -10)], "q_score int, fit_score int"
    )

    def counts(**kwargs):
        rows = review.dense_histogram(scores, ("q_score",), **kwargs).collect()
        return {r.bucket: r.n for r in rows}, {r.label for r in rows}

    plain, labels = counts()
    assert plain == {0: 2, 10: 1, 20: 0, 30: 1, 40: 1, 50: 0, 60: 0, 70: 0, 80: 0, 90: 1}
    assert "0–9" in labels and "90–99" in labels
    assert counts(closed_top=True)[0][90] == 2
    nothing = review.dense_histogram(scores.limit(0)).collect()
    assert len(nothing) == 20 and {r.n for r in nothing} == {0}


def test_provider_counts_each_listing_once(frame):
    _, rows, _ = frame
    assert [(r.ats, r.jobs) for r in review.provider_counts(rows).collect()] == [
        ("unknown", 2), ("lever", 1),
    ]


def test_provider_of_the_first_row_wins(spark):
    rows = spark.createDataFrame(
        [("Acme", "Data", "b", 2), ("Acme", "Data", "a", 1), ("Acme", "Ops", "b", 3)],
        "company string, title string, ats string, k int",
    )
    assert [tuple(r) for r in review.provider_counts(rows, ("k",)).collect()] == [
        ("a", 1), ("b", 1),
    ]


def test_winners_use_the_version_stored_last(frame):
    scores, rows, _ = frame
    order = F.struct("created_at", "job_id")
    assert review.latest_version(scores, order).first()[0] == "p1"
    won = review.winners(rows, review.latest_version(scores, order), 40, 40)
    assert [r.job_id for r in won.collect()] == ["j3", "j2"]
    before = scores.filter("created_at < 7")
    older = review.winners(rows, review.latest_version(before, order), 10, 40)
    assert [(r.job_id, r.profile_version) for r in older.collect()] == [("j1", "p2"), ("j2", "p2")]


def test_phrase_coverage_folds_ascii_case_only(spark):
    rows = spark.createDataFrame(
        [("Applied AI lead",), ("APPLIED ai",), ("applied  ai",), ("É applied ai",), ("Sales",)],
        "title string",
    )
    got = review.phrase_coverage(rows, phrases=("applied ai", "nothing", "é"))
    assert [tuple(r) for r in got.collect()] == [("applied ai", 3), ("nothing", 0), ("é", 0)]


def test_report_line(apply):
    rows = [("A" * 30, "T" * 50, 5, 100), ("Acme", "Data", 1000, -10), (None, "Data", 1, None)]
    expected = [
        "AAAAAAAAAAAAAAAAAAAAAAAA  TTTTTTTTTTTTTTTTTTTTTTTTTTTTTTTTTTTTTTTTTTTT    5 100",
        "Acme                      Data                                          1000 -10",
        "                          Data                                            1    ",
    ]
    assert apply(review.report_line, rows, "c string, t string, q int, f int") == expected
