"""Integrity and freshness checks over the stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F



def orphan_count(child: DataFrame, foreign_key: str, parent: DataFrame, key: str) -> DataFrame:
    """How many child rows point to no parent.

    Both sides are reduced to one row per key first, so a parent with very many children costs one
    row in the join.
    """
    per_key = child.groupBy(F.col(foreign_key).alias("_key")).agg(F.count("*").alias("_rows"))
    parents = parent.select(F.col(key).alias("_key")).distinct()
    missing = per_key.join(parents, "_key", "left_anti")
    return missing.agg(
        F.coalesce(F.sum("_rows"), F.lit(0)).cast("bigint").alias("orphans")
    )


def duplicate_keys(rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Keys that occur more than once, with their number of rows."""
    return rows.groupBy(*keys).agg(F.count("*").alias("copies")).filter("copies > 1")


def null_violations(rows: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Null count of each column that must not be null, in one pass."""
    counts = rows.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in columns))
    return counts.unpivot([], list(columns), "column_name", "nulls")


def stale(rows: DataFrame, source: str, seen: str) -> DataFrame:
    """Rows not sighted in the latest pull of their source.

    There is one latest sighting per source, found with a partial aggregate and joined back. The
    join carries no hint: adaptive execution broadcasts the latest sightings by their real size and
    otherwise splits large sources; a window per source would gather a source in one task.
    """
    latest = rows.groupBy(F.col(source).alias("_source")).agg(F.max(seen).alias("_latest"))
    joined = rows.join(latest, rows[source] == F.col("_source"))
    return joined.filter(F.col(seen) < F.col("_latest")).drop("_source", "_latest")
