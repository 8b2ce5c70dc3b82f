"""Candidate selection and the work queue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from listwright.fixed_values import (
    CYCLE_YEAR, LATEST_OPEN_SEASONS, OPEN_SEASONS, QUEUE_PREVIEW_ROWS,
)
from listwright.functions import text as tx
from listwright.functions.rules import TierRules
from listwright.operators.tiering import DEFAULT_RULES, in_tiers, with_tier
from listwright.sources.scratch import scratch_dir

# What the queue needs of a job.
QUEUE_COLUMNS = (
    "job_id", "company_id", "title", "locations", "season", "sponsorship", "url", "posted_at",
)


def is_candidate(
    active: Column, season: Column, cycle: str = CYCLE_YEAR,
    open_seasons: tuple[str, ...] = OPEN_SEASONS,
) -> Column:
    """Active and of the wanted cycle, in any ASCII case; a listing without a season is none."""
    of_cycle = tx.ascii_lower(season).contains(tx.ascii_lower(F.lit(cycle)))
    return active & (of_cycle | season.isin(*open_seasons))


def candidates(
    jobs: DataFrame, cycle: str = CYCLE_YEAR, open_seasons: tuple[str, ...] = OPEN_SEASONS
) -> DataFrame:
    return jobs.filter(is_candidate(F.col("active"), F.col("season"), cycle, open_seasons))


def newest_first(posted: str = "posted_at", key: str = "job_id") -> list[Column]:
    return [F.desc_nulls_last(posted), F.asc(key)]


def latest_candidate(
    jobs: DataFrame, cycle: str = CYCLE_YEAR,
    open_seasons: tuple[str, ...] = LATEST_OPEN_SEASONS,
) -> DataFrame:
    return candidates(jobs, cycle, open_seasons).orderBy(*newest_first()).limit(1)


def with_company(jobs: DataFrame, companies: DataFrame) -> DataFrame:
    """Attach the company name.

    No broadcast hint: companies grow with the data. Read from files their size is known, so the
    planner broadcasts them while they are small and otherwise shuffles, splitting hot companies.
    """
    names = companies.select("company_id", F.col("name").alias("company_name"))
    return jobs.join(names, "company_id")


def unscored(
    jobs: DataFrame, scores: DataFrame, profile_version: str, resume_version: str
) -> DataFrame:
    """Jobs without a score under exactly these two versions.

    The scored side is made distinct first. That uses the exchange the join needs anyway, and a job
    with very many scores then weighs one row per task instead of all of them in one task.
    """
    done = scores.filter(
        (F.col("profile_version") == profile_version)
        & (F.col("resume_version") == resume_version)
    ).select("job_id").distinct()
    return jobs.join(done, "job_id", "left_anti")


def take(queue: DataFrame, limit: int | None) -> DataFrame:
    """The first `limit` rows by recency; none or zero means the whole queue, unsorted."""
    return queue.orderBy(*newest_first()).limit(limit) if limit else queue


def build_queue(
    jobs: DataFrame, companies: DataFrame, scores: DataFrame, profile_version: str,
    resume_version: str, preset: str | tuple[str, ...] = "tier1",
    rules: TierRules = DEFAULT_RULES, limit: int | None = None, cycle: str = CYCLE_YEAR,
    open_seasons: tuple[str, ...] = OPEN_SEASONS,
) -> DataFrame:
    """Unscored candidates of the wanted tiers with what the scorer needs of each.

    The raw payload is left behind before the first exchange. The tier filter runs before the
    anti-join, so that join only sees rows that would be scored.
    """
    wanted = candidates(jobs, cycle, open_seasons).select(*QUEUE_COLUMNS)
    tiered = in_tiers(with_tier(with_company(wanted, companies), rules), preset)
    return take(unscored(tiered, scores, profile_version, resume_version), limit)


def preview(queue: DataFrame, rows: int = QUEUE_PREVIEW_ROWS) -> DataFrame:
    """The first rows of the queue with its size and how many rows are not shown.

    The queue is planned and run once, into the shared folder; rows and size are read from there. An
    empty queue shows one row without a listing, with its size 0.
    """
    spark = queue.sparkSession
    path = scratch_dir(spark, "preview")
    queue.write.parquet(path)
    planned = spark.read.schema(queue.schema).parquet(path)
    size = planned.agg(F.count("*").alias("queue_size"))
    first = planned.orderBy(*newest_first()).limit(rows).withColumn("queue_size", size.scalar())
    empty = size.filter("queue_size = 0").select(
        *(F.lit(None).cast(field.dataType).alias(field.name) for field in queue.schema.fields), "queue_size"
    )
    return first.union(empty).withColumn("not_shown", F.greatest(F.col("queue_size") - rows, F.lit(0)))


def depth(queue: DataFrame) -> DataFrame:
    return queue.groupBy("tier").agg(F.count("*").alias("n"))
