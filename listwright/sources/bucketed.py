"""Tables bucketed by a key, so that joins and anti-joins on it need no exchange.

Scores and listings that are joined again and again are dealt by listing once, when they are written.
Tables with as many buckets join bucket by bucket; the number has to fit the larger one, as
`buckets_for` takes it from the rows, since a bucket is sorted by one task. A hot key is one bucket: of tables with one, bucket the side that has
each key once and let the planner shuffle the other.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame

from listwright.sources.scratch import scratch_dir


#: About 128 MB of narrow rows in memory.
ROWS_PER_BUCKET = 1_000_000


def buckets_for(*tables: DataFrame, least: int = 8, rows_per_bucket: int = ROWS_PER_BUCKET) -> int:
    """Buckets of tables that are joined: a bucket of the largest holds about `rows_per_bucket` rows."""
    return max(least, *(math.ceil(rows.count() / rows_per_bucket) for rows in tables))


def write_bucketed(rows: DataFrame, name: str, key: str, buckets: int, path: str | None = None) -> DataFrame:
    """Write rows as a table sorted and bucketed by `key`, and read it.

    The files go to `path`, by default a new one in the shared folder; the session's catalog keeps the
    table's name and buckets.
    """
    spark = rows.sparkSession
    table = f"{name}_{uuid.uuid4().hex}"
    where = path or scratch_dir(spark, name)
    # Dealt first, so that each bucket is one file and not one per task.
    rows.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).option("path", where).saveAsTable(table)
    return spark.table(table)
