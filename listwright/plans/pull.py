"""Pull: feeds -> normalized listings -> companies and jobs, in one commit."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame, functions as F

from listwright import schemas
from listwright.operators import merge
from listwright.operators.normalize import BAD, KEPT, enrich, normalize, verdict_counts
from listwright.sources.feeds import Feed, failed_feed, feed_status, read_feed
from listwright.sources.store import Commit, Part, Store


@dataclass(frozen=True)
class PullReport:
    version: int
    total_seen: int
    inserted: int
    updated: int


def stage(store: Store, raw: DataFrame, batch_id: int) -> Part:
    """Normalize and enrich once, written by verdict; later steps read what they need of it.

    The payload is parsed and the URL, key and hash expressions run exactly once per listing,
    however many tables are built from them, and a lost executor costs no second parse.
    """
    return store.write_part("staging", enrich(normalize(raw, batch_id)), ("verdict",))


def stage_feeds(store: Store, registry: Sequence[Feed], batch_id: int) -> list[Part]:
    """Each feed staged by itself: one that cannot be read to its end leaves a failure marker.

    A failure of the store is not the feed's: where the feed can be read after all, the error stands.
    """
    parts = []
    for ordinal, feed in enumerate(registry):
        try:
            parts.append(stage(store, read_feed(store.spark, feed, ordinal), batch_id))
        except Exception:  # whatever reading raises must not stop the other feeds
            if _readable(store, feed, ordinal):
                raise
            parts.append(stage(store, failed_feed(store.spark, feed, ordinal), batch_id))
    return parts


def _readable(store: Store, feed: Feed, ordinal: int) -> bool:
    try:
        read_feed(store.spark, feed, ordinal).write.format("noop").mode("overwrite").save()
    except Exception:  # as above
        return False
    return True


def _staged(store: Store, parts: Sequence[Part], verdict: str) -> DataFrame:
    return store.read_parts(parts, schemas.STAGED).filter(F.col("verdict") == verdict)


def merge_staged(
    store: Store, parts: Sequence[Part], base: Commit, run_at: datetime, stream: str | None = None,
    stream_batch: int | None = None,
) -> PullReport:
    """Fold the staged listings into both tables and publish them together."""
    now = F.lit(run_at).cast("timestamp")
    kept = _staged(store, parts, KEPT)
    jobs, companies = merge.job_sightings(kept, now), merge.company_sightings(kept, now)
    stats = merge.merge_stats(
        store.read_unfolded("jobs", base), kept, ("source", "source_id")
    ).first()
    changes = {
        "companies": store.write_fold("companies", companies, base),
        "jobs": store.write_fold("jobs", jobs, base),
        "staging": list(parts),
    }
    published = store.commit(base, changes, stream, stream_batch)
    return PullReport(published.version, stats.total_seen, stats.inserted, stats.updated)


def pull(
    store: Store, registry: Sequence[Feed], run_at: datetime | None = None
) -> PullReport:
    """One pull of all feeds. Nothing is visible to readers until the final commit."""
    base = store.initialize()
    parts = stage_feeds(store, registry, base.version + 1)
    return merge_staged(store, parts, base, run_at or datetime.now(timezone.utc))


def _last_staging(store: Store) -> DataFrame:
    return store.read_parts(store.current().parts("staging"), schemas.STAGED)


def source_counts(store: Store) -> DataFrame:
    """Kept, skipped, bad and total objects per feed of the last pull."""
    return verdict_counts(_last_staging(store))


def source_status(store: Store) -> DataFrame:
    """Which feed files of the last pull could be read."""
    rows = _last_staging(store).select(
        "source", F.col("seq.source_ord"), F.col("seq.file"), F.col("seq.pos"), "feed_status"
    )
    return feed_status(rows)


def dead_letters(store: Store) -> DataFrame:
    """Objects of the last pull that could not become listings, with the reason."""
    rows = _last_staging(store).filter(F.col("verdict") == BAD)
    return rows.select("source", "seq", "reason", "raw_payload")
