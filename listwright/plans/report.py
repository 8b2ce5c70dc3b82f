"""Reports over a store."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from listwright.functions import text as tx
from listwright.operators import review
from listwright.operators.checks import stale
from listwright.operators.normalize import same_content_across_sources
from listwright.sources.store import Commit, Store


def review_frame(
    store: Store, commit: Commit | None = None, latest_only: bool = False
) -> DataFrame:
    """Scores with listing and company, ready for the review queries.

    All versions are included, so a listing appears once per version, unless only those of the
    profile version stored last are wanted.
    """
    now = commit or store.current()
    scores, *listings = _star(store, now)
    if latest_only:
        scores = scores.filter(F.col("profile_version") == latest_profile(store, now).scalar())
    return review.review_columns(review.score_view(scores, *listings))


def _star(store: Store, now: Commit) -> tuple[DataFrame, DataFrame, DataFrame]:
    return (
        store.read("match_scores", now),
        store.read("jobs", now, ("job_id", "company_id", "title", "locations", "url")),
        store.read("companies", now, ("company_id", "name", "ats_provider")),
    )


def latest_profile(store: Store, commit: Commit | None = None) -> DataFrame:
    scores = store.read("match_scores", commit)
    return review.latest_version(scores, F.struct("created_at", "batch_id", "job_id"))


def winners(store: Store, commit: Commit | None = None) -> DataFrame:
    now = commit or store.current()
    star = _star(store, now)
    return review.described(
        review.winners(review.rankable(*star), latest_profile(store, now)), *star
    )


def report_lines(rows: DataFrame) -> DataFrame:
    """Text lines of a ranked review frame, with the columns that order them."""
    line = review.report_line(
        F.col("company"), F.col("title"), F.col("q_score"), F.col("fit_score")
    )
    return rows.select("combined", "job_id", line.alias("line"))


def stale_listings(store: Store, commit: Commit | None = None) -> DataFrame:
    """Listings that the latest pull of their source no longer contained."""
    jobs = store.read("jobs", commit, ("job_id", "source", "source_id", "last_seen_at"))
    return stale(jobs, "source", "last_seen_at")


def cross_source_duplicates(store: Store, commit: Commit | None = None) -> DataFrame:
    """Listings that several feeds published, by fingerprint."""
    jobs = store.read("jobs", commit, ("source", "fingerprint"))
    return same_content_across_sources(jobs, "fingerprint", "source")


def fingerprints(store: Store, commit: Commit | None = None) -> DataFrame:
    """The fingerprint stored at the first sighting beside that of the current title and places."""
    now = commit or store.current()
    jobs = store.read("jobs", now, ("job_id", "company_id", "fingerprint", "title", "locations"))
    companies = store.read("companies", now, ("company_id", "name_normalized"))
    current = tx.fingerprint(F.col("name_normalized"), F.col("title"), F.col("locations"))
    return jobs.join(companies, "company_id").select(
        "job_id", "fingerprint", current.alias("fingerprint_current")
    )
