"""Score: build the queue, write it, call the scorer chunk by chunk, commit each chunk."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, functions as F

from listwright.fixed_values import CYCLE_YEAR, OPEN_SEASONS
from listwright.functions.rules import TierRules
from listwright.operators import queue as q, scoring
from listwright.operators.tiering import DEFAULT_RULES
from listwright.sources.config import ConfigDocument
from listwright.sources.store import Store


@dataclass(frozen=True)
class ScoreReport:
    queued: int
    scored: int
    failed: int


@dataclass(frozen=True)
class ScoreRun:
    """What a scoring run is made with."""

    profile: ConfigDocument
    resume: ConfigDocument
    model: str
    preset: str | tuple[str, ...] = "tier1"
    rules: TierRules = DEFAULT_RULES
    limit: int | None = None
    cycle: str = CYCLE_YEAR
    open_seasons: tuple[str, ...] = OPEN_SEASONS
    chunks: int = 8
    # Concurrent scorer calls; the number of shuffle partitions if not given.
    parallel_calls: int | None = None

    def template(self) -> scoring.RequestTemplate:
        return scoring.RequestTemplate(profile=self.profile.text, resume=self.resume.text)


def queue_of(store: Store, run: ScoreRun) -> DataFrame:
    now = store.current()
    jobs = store.read("jobs", now, (*q.QUEUE_COLUMNS, "active"))
    return q.build_queue(
        jobs, store.read("companies", now, ("company_id", "name")),
        store.read("match_scores", now, scoring.SCORE_KEY),
        run.profile.version, run.resume.version, run.preset, run.rules, run.limit, run.cycle,
        run.open_seasons,
    )


def dry_run(store: Store, run: ScoreRun) -> DataFrame:
    """First rows of the queue and its size, without scoring anything."""
    return q.preview(queue_of(store, run)).select(
        "tier", "company_name", "title", "posted_at", "job_id", "queue_size", "not_shown"
    )


def score(
    store: Store, run: ScoreRun, factory: scoring.ScorerFactory, run_at: datetime | None = None
) -> ScoreReport:
    """Score the queue.

    The queue and each chunk's answers are written before they are read, so a retried task or a
    second action does not call the scorer again for finished work. Every chunk is committed on its
    own: a run that dies keeps its finished chunks, and the next run's queue leaves them out.
    Failed answers are kept apart and stay in the queue.
    """
    now = F.lit(run_at or datetime.now(timezone.utc)).cast("timestamp")
    chunk = F.pmod(F.xxhash64("job_id"), F.lit(run.chunks)).cast("int")
    planned = queue_of(store, run).withColumn("chunk", chunk)
    queue = store.read_part(store.write_part("queue", planned, ("chunk",)), planned.schema)
    scored = failed = 0
    for row in queue.groupBy("chunk").count().orderBy("chunk").collect():
        todo = queue.filter(F.col("chunk") == row.chunk).drop("chunk")
        answered, unusable = _score_chunk(store, run, factory, todo, now)
        scored, failed = scored + answered - unusable, failed + unusable
    return ScoreReport(scored + failed, scored, failed)


def _score_chunk(
    store: Store, run: ScoreRun, factory: scoring.ScorerFactory, todo: DataFrame, now: Column
) -> tuple[int, int]:
    """Call, parse and append one chunk; returns the number of answers and of failed ones."""
    # Spread by an explicit number: rows are small but calls are slow, and adaptive execution would
    # merge small partitions into a few.
    calls = run.parallel_calls or int(store.spark.conf.get("spark.sql.shuffle.partitions"))
    spread = todo.repartition(calls, "job_id")
    answers_part = store.write_part(
        "responses", scoring.call_scorer(spread, factory, run.template())
    )
    answers = store.read_part(answers_part, scoring.RESPONSE_SCHEMA)
    parsed = scoring.parse_response(answers)
    base = store.current()
    batch_id = base.version + 1
    rows = scoring.as_match_scores(
        scoring.parsed_ok(parsed), run.profile.version, run.resume.version, run.model, now,
        batch_id,
    )
    versions = (
        (F.col("profile_version") == run.profile.version)
        & (F.col("resume_version") == run.resume.version)
    )
    fresh = scoring.insert_or_ignore(
        store.read("match_scores", base).filter(versions), rows, scoring.SCORE_KEY,
        F.col("created_at"),
    )
    dead = scoring.parsed_failed(parsed).select(
        "job_id",
        F.lit(run.profile.version).alias("profile_version"),
        F.lit(run.resume.version).alias("resume_version"),
        "response", "error",
        F.lit(batch_id).cast("bigint").alias("batch_id"),
    )
    by_version = ("profile_version", "resume_version")
    score_part = store.write_part("match_scores", fresh, by_version)
    dead_part = store.write_part("dead_scores", dead)
    store.commit(base, {
        "match_scores": [*base.parts("match_scores"), score_part],
        "dead_scores": [*base.parts("dead_scores"), dead_part],
    })
    return answers_part.rows, dead_part.rows
