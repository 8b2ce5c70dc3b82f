"""Incremental pull: a directory of arriving feed files, merged micro-batch by micro-batch."""

from __future__ import annotations

import json
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from listwright.plans.pull import merge_staged, stage
from listwright.sources.feeds import Feed, as_raw, tag
from listwright.sources.store import Store


def stream_feed(store: Store, feed: Feed, ordinal: int = 0) -> DataFrame:
    """Raw listings of the files that arrive under the feed's path."""
    reader = store.spark.readStream.format("text")
    if feed.layout == "array":
        reader = reader.option("wholetext", True)
    return as_raw(tag(reader.load(feed.path), feed, ordinal), feed.layout)


def checkpointed_name(store: Store, stream: str, checkpoint: str) -> str:
    """The stream's name with the id its checkpoint has; a new checkpoint is a new stream."""
    written = store.spark.read.text(f"{checkpoint.rstrip('/')}/metadata").first()[0]
    return f"{stream}@{json.loads(written)['id']}"


def once_per_batch(
    store: Store, stream: str, checkpoint: str, apply: Callable[[DataFrame, int, str], None]
) -> Callable[[DataFrame, int], None]:
    """foreachBatch body that skips a micro-batch whose commit is already in the store.

    The engine repeats a micro-batch when it stopped between the commit and the checkpoint. Numbers
    count from 0 under each checkpoint, so they are compared within one checkpoint only.
    """

    def body(batch: DataFrame, batch_id: int) -> None:
        name = checkpointed_name(store, stream, checkpoint)
        if batch_id > store.last_stream_batch(name):
            apply(batch, batch_id, name)

    return body


def stream_pull(
    store: Store, raw: DataFrame, stream: str, checkpoint: str,
    run_at: Callable[[], datetime] = lambda: datetime.now(timezone.utc),
) -> StreamingQuery:
    """Merge every micro-batch of raw listings into the store, then stop."""
    store.initialize()

    def apply(batch: DataFrame, batch_id: int, name: str) -> None:
        base = store.current()
        part = stage(store, batch, base.version + 1)
        merge_staged(store, [part], base, run_at(), name, batch_id)

    return (
        raw.writeStream.foreachBatch(once_per_batch(store, stream, checkpoint, apply))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def stream_fold(
    store: Store, sightings: DataFrame, table: str, stream: str, checkpoint: str
) -> StreamingQuery:
    """Fold every micro-batch of rows in state shape into one table of the store, then stop."""
    store.initialize()

    def apply(batch: DataFrame, batch_id: int, name: str) -> None:
        base = store.current()
        store.commit(base, {table: store.write_fold(table, batch, base)}, name, batch_id)

    return (
        sightings.writeStream.foreachBatch(once_per_batch(store, stream, checkpoint, apply))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
