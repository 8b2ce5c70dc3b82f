"""Review queries over scores, listings and companies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from listwright.fixed_values import (
    COVERAGE_PHRASES, HISTOGRAM_BUCKETS, NO_LOCATION, REPORT_COMPANY, REPORT_SCORE_WIDTH,
    REPORT_TITLE, TARGETS_MIN_QUALIFICATION, TARGETS_ROWS, TIER_NAMED, TOP_ROWS,
    UNKNOWN_PROVIDER, WINNERS_MIN_FIT, WINNERS_MIN_QUALIFICATION, WINNERS_ROWS,
)
from listwright.functions import text as tx


def score_view(scores: DataFrame, jobs: DataFrame, companies: DataFrame) -> DataFrame:
    """Scores with their listing and its company.

    The provider is the company's. Listings meet their companies first, so the scores move once, by
    listing, and never by the skewed company. The joins carry no hint: both sides grow with the data,
    so the planner decides from their size.
    """
    job_columns = jobs.select("job_id", "company_id", "title", "locations", "url")
    company_columns = companies.select(
        "company_id", F.col("name").alias("company"), "ats_provider"
    )
    score_columns = scores.select(
        "job_id", "profile_version", "resume_version",
        F.col("qualification_score").alias("q_score"), "fit_score", "summary", "tier",
        "created_at",
    )
    listed = job_columns.join(company_columns, "company_id")
    columns = [c for c in job_columns.columns if c not in ("job_id", "company_id")]
    return score_columns.join(listed, "job_id").select(
        "company_id", "job_id", *score_columns.columns[1:], *columns, "company", "ats_provider"
    )


def bucketed_view(scores: DataFrame, jobs: DataFrame, companies: DataFrame) -> DataFrame:
    """`score_view` of scores and listings that are tables bucketed by listing.

    Scores meet their listing bucket by bucket, so neither moves; what is joined then moves by company,
    unless the companies are small enough to be broadcast.
    """
    listings = jobs.select("job_id", "company_id", "title", "locations", "url").hint("merge")
    names = companies.select("company_id", F.col("name").alias("company"), "ats_provider")
    scored = scores.select(
        "job_id", "profile_version", "resume_version", F.col("qualification_score").alias("q_score"), "fit_score",
        "summary", "tier", "created_at",
    )
    return scored.join(listings, "job_id").join(names, "company_id")


def review_columns(view: DataFrame) -> DataFrame:
    """Display columns: joined locations, provider and summary defaults, combined score."""
    locations = F.when(
        F.coalesce(F.size("locations"), F.lit(0)) <= 0, F.lit(NO_LOCATION)
    ).otherwise(F.array_join("locations", ", "))
    return view.select(
        "job_id", "profile_version", "resume_version", "company", "title",
        locations.alias("locations"), "url",
        tx.or_default(F.col("ats_provider"), UNKNOWN_PROVIDER).alias("ats"),
        "q_score", "fit_score",
        (F.col("q_score") + F.col("fit_score")).alias("combined"),
        F.coalesce("summary", F.lit("")).alias("summary"),
        "tier", "created_at",
    )


SCORE_KEY_COLUMNS = ("job_id", "profile_version", "resume_version")


def rankable(scores: DataFrame, jobs: DataFrame, companies: DataFrame) -> DataFrame:
    """Scores whose listing and company exist, with what ranking needs and nothing wide."""
    named = jobs.select("job_id", "company_id").join(
        companies.select("company_id"), "company_id", "left_semi"
    )
    q_score = F.col("qualification_score")
    return scores.join(named.select("job_id"), "job_id", "left_semi").select(
        *SCORE_KEY_COLUMNS, q_score.alias("q_score"), "fit_score",
        (q_score + F.col("fit_score")).alias("combined"),
    )


def described(
    chosen: DataFrame, scores: DataFrame, jobs: DataFrame, companies: DataFrame
) -> DataFrame:
    """Review columns of the rows of a top list over `rankable`, best first.

    Titles, places, links and summaries are fetched for the list alone. What is broadcast has at
    most as many rows as the list.
    """
    key = list(SCORE_KEY_COLUMNS)
    rows = scores.join(F.broadcast(chosen.select(*key)), key, "left_semi")
    listed = F.broadcast(rows.withColumnRenamed("qualification_score", "q_score")).join(
        jobs.select("job_id", "company_id", "title", "locations", "url"), "job_id"
    )
    named = companies.select("company_id", F.col("name").alias("company"), "ats_provider")
    return review_columns(F.broadcast(listed).join(named, "company_id")).orderBy(*best_first())


def scored_listings(scores: DataFrame, jobs: DataFrame, companies: DataFrame) -> DataFrame:
    """job_id, company, title and provider of each listing that has a score.

    Of a listing's scores only its id moves, once per task and listing.
    """
    scored = scores.select("job_id").distinct()
    listed = jobs.select("job_id", "company_id", "title").join(scored, "job_id", "left_semi")
    named = companies.select(
        "company_id", F.col("name").alias("company"),
        tx.or_default(F.col("ats_provider"), UNKNOWN_PROVIDER).alias("ats"),
    )
    return listed.join(named, "company_id").select("job_id", "company", "title", "ats")


def best_first(key: Sequence[str] = SCORE_KEY_COLUMNS, by: str = "combined") -> list[Column]:
    """Highest first; equal scores are ordered by the score's key, so the order is total."""
    return [F.desc(by), *(F.asc(k) for k in key)]


def top_targets(
    review: DataFrame, minimum: int = TARGETS_MIN_QUALIFICATION, rows: int = TARGETS_ROWS,
    key: Sequence[str] = SCORE_KEY_COLUMNS,
) -> DataFrame:
    """Best combined scores among those qualified enough, over all versions."""
    return review.filter(F.col("q_score") >= minimum).orderBy(*best_first(key)).limit(rows)


def top_combined(
    review: DataFrame, rows: int = TOP_ROWS, key: Sequence[str] = SCORE_KEY_COLUMNS
) -> DataFrame:
    return review.orderBy(*best_first(key)).limit(rows)


def best_per_company(
    review: DataFrame, tier: str = TIER_NAMED, key: Sequence[str] = SCORE_KEY_COLUMNS
) -> DataFrame:
    """The best listing of every company spelling in a tier, best company first.

    An aggregate, not a window: each task keeps one row per company before the exchange, so a
    company with very many listings does not end up sorted in one task.
    """
    chosen = review.filter(F.col("tier") == tier)
    carried = [c for c in review.columns if c != "company"]
    # min_by on the negated score: smallest is best, and the key breaks ties upwards.
    rank = F.struct((-F.col("combined")).alias("_score"), *key)
    best = chosen.groupBy("company").agg(F.min_by(F.struct(*carried), rank).alias("_best"))
    return best.select(
        "company", *(F.col(f"_best.{c}").alias(c) for c in carried)
    ).orderBy(F.desc("combined"), F.asc("company"))


def best_listings(
    scores: DataFrame, jobs: DataFrame, companies: DataFrame, tier: str = TIER_NAMED,
    key: Sequence[str] = SCORE_KEY_COLUMNS,
) -> DataFrame:
    """`best_per_company` of the review frame, which is made for the chosen scores only.

    Companies are ranked on keys and scores alone: the aggregate holds no titles, places or summaries.
    Needs what the score table has, one row per key.
    """
    spelled = jobs.select("job_id", "company_id").join(
        companies.select("company_id", F.col("name").alias("company")), "company_id"
    )
    combined = F.col("qualification_score") + F.col("fit_score")
    ranked = scores.filter(F.col("tier") == tier).select(*key, combined.alias("_combined")).join(spelled, "job_id")
    best = ranked.groupBy("company").agg(
        F.min(F.struct((-F.col("_combined")).alias("_score"), *key)).alias("_best")
    ).select(*(F.col(f"_best.{c}").alias(c) for c in key))
    chosen = scores.join(best, list(key), "left_semi")
    return review_columns(score_view(chosen, jobs, companies)).orderBy(F.desc("combined"), F.asc("company"))


def kpis(jobs: DataFrame, scores: DataFrame) -> DataFrame:
    """Total and active listings, number of scores, time of the latest score, in one row."""
    per_jobs = jobs.agg(
        F.count("*").alias("total_jobs"),
        F.count_if("active").alias("total_active"),
    )
    per_scores = scores.agg(
        F.count("*").alias("total_scored"),
        F.max("created_at").alias("last_refreshed"),
    )
    both = per_jobs.unionByName(per_scores, allowMissingColumns=True)
    return both.agg(*(
        F.max(c).alias(c) for c in ("total_jobs", "total_active", "total_scored", "last_refreshed")
    ))


def dense_histogram(
    scores: DataFrame, columns: Sequence[str] = ("q_score", "fit_score"),
    closed_top: bool = False, buckets: Sequence[int] = HISTOGRAM_BUCKETS,
) -> DataFrame:
    """Counts per score axis and ten-wide bucket, empty buckets included.

    A score of 100 belongs to a bucket past the last one and is not shown, nor is a negative one;
    `closed_top` counts 100 in the top bucket instead. Scores are reduced to bucket combinations
    before anything else happens, and the empty buckets are added as rows that count zero.
    """
    top = buckets[-1]

    def bucket(name: str) -> Column:
        start = (F.floor(F.col(name) / 10) * 10).cast("int")
        return F.when(F.col(name) == top + 10, F.lit(top)).otherwise(start) if closed_top else start

    combined = scores.groupBy(*(bucket(c).alias(c) for c in columns)).agg(
        F.count("*").alias("_n")
    )
    counted = combined.select(F.inline(F.array(*(
        F.struct(
            F.lit(c).alias("axis"), F.col(c).alias("bucket"), F.col("_n").alias("_n")
        ) for c in columns
    ))))
    empty = scores.sparkSession.range(len(buckets), numPartitions=1).select(
        F.get(F.array(*map(F.lit, buckets)), F.col("id").cast("int")).alias("bucket")
    ).select(
        F.explode(F.array(*map(F.lit, columns))).alias("axis"), "bucket",
        F.lit(0).cast("bigint").alias("_n"),
    )
    return (
        counted.unionByName(empty)
        .filter(F.col("bucket").isin(*buckets))
        .groupBy("axis", "bucket").agg(F.sum("_n").alias("n"))
        .withColumn(
            "label",
            F.concat(F.col("bucket").cast("string"), F.lit("–"),
                     (F.col("bucket") + 9).cast("string")),
        )
    )


def provider_counts(review: DataFrame, key: Sequence[str] = SCORE_KEY_COLUMNS) -> DataFrame:
    """Scored listings per provider, each (company, title) counted once with its first provider."""
    once = review.groupBy("company", "title").agg(
        F.min_by("ats", F.struct(*key)).alias("ats")
    )
    return once.groupBy("ats").agg(F.count("*").alias("jobs")).orderBy(F.desc("jobs"), F.asc("ats"))


def latest_version(scores: DataFrame, order: Column, version: str = "profile_version") -> DataFrame:
    """One row with the version of the score stored last."""
    return scores.agg(F.max_by(version, order).alias(version))


def winners(
    review: DataFrame, latest: DataFrame,
    min_qualification: int = WINNERS_MIN_QUALIFICATION, min_fit: int = WINNERS_MIN_FIT,
    rows: int = WINNERS_ROWS, key: Sequence[str] = SCORE_KEY_COLUMNS,
) -> DataFrame:
    """Best scores of the latest profile version that pass both minimums."""
    current = review.filter(
        (F.col("profile_version") == latest.scalar())
        & (F.col("q_score") >= min_qualification)
        & (F.col("fit_score") >= min_fit)
    )
    return current.orderBy(*best_first(key)).limit(rows)


def phrase_coverage(
    rows: DataFrame, title: str = "title", phrases: Sequence[str] = COVERAGE_PHRASES
) -> DataFrame:
    """How many titles contain each phrase, any ASCII case; zero counts included. One pass."""
    text = tx.ascii_lower(F.col(title))
    counters = [
        F.count_if(text.contains(phrase.lower())).alias(f"n_{number}")
        for number, phrase in enumerate(phrases)
    ]
    listed = F.array(*(
        F.struct(F.lit(phrase).alias("phrase"), F.col(f"n_{number}").alias("n"))
        for number, phrase in enumerate(phrases)
    ))
    return rows.agg(*counters).select(F.inline(listed))


def report_line(company: Column, title: Column, q: Column, fit: Column) -> Column:
    """One line of the fixed-width text report."""

    def cell(text: Column, size: tuple[int, int]) -> Column:
        kept, width = size
        return F.rpad(F.left(F.coalesce(text, F.lit("")), F.lit(kept)), width, " ")

    def number(value: Column) -> Column:
        # lpad also cuts, so wider numbers are passed through.
        shown = F.coalesce(value.cast("string"), F.lit(""))
        return F.when(F.length(shown) >= REPORT_SCORE_WIDTH, shown).otherwise(
            F.lpad(shown, REPORT_SCORE_WIDTH, " ")
        )

    gap = F.lit(" ")
    return F.concat(
        cell(company, REPORT_COMPANY), gap, cell(title, REPORT_TITLE), gap, number(q), gap, number(fit)
    )
