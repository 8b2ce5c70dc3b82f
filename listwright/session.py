"""Session settings. Only what is not already set is filled in."""

from __future__ import annotations

import math

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Rendered prompts are wide rows, so keep Arrow batches small.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    # A JSON object that repeats a key keeps the last value.
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.ui.enabled": "false",
}


def build_session(app: str = "listwright", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shuffle_conf(input_bytes: int, cores: int, target_bytes: int = 128 << 20) -> dict[str, str]:
    """Shuffle settings for an input size.

    Adaptive execution can merge partitions that are too small but does not split large ones in an
    aggregation, so the starting number has to come from the data: one per `target_bytes`, and
    never fewer than two per core.
    """
    partitions = max(2 * cores, math.ceil(input_bytes / target_bytes))
    return {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_bytes),
        "spark.sql.files.maxPartitionBytes": str(target_bytes),
    }
