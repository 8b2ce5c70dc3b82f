"""Feed registry and feed readers.

A feed is one or more files of JSON listings. Two layouts are read:

* ``array``: each file is one JSON array, as feeds are published. A file is the unit of failure, but
  is read by as many tasks as it has byte ranges (`sources.arrays`). As a stream, where a micro-batch
  is to be one plan, a file is one task.
* ``lines``: one ``{"pos": n, "listing": {...}}`` object per line, written when a feed is landed.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from listwright import schemas
from listwright.sources.arrays import read_arrays
from listwright.sources.elements import FEED_FAILED, FEED_OK, as_json_text, element_texts


@dataclass(frozen=True)
class Feed:
    name: str
    path: str
    layout: str = "array"


def _array_documents(documents: DataFrame) -> DataFrame:
    """(source, source_ord, file, document) -> raw listings.

    A file that is empty or is not one array leaves a marker row without a position.
    """
    parsed = element_texts(documents, "source", "source_ord", "file")
    return parsed.select(
        "source", "source_ord", "file",
        F.when(F.col("elements").isNull(), FEED_FAILED).otherwise(FEED_OK).alias("feed_status"),
        F.posexplode_outer("elements").alias("pos", "payload"),
    )


def _line_records(lines: DataFrame) -> DataFrame:
    """(source, source_ord, file, document) -> raw listings.

    A line that lacks its position or its listing stays as a bad row, with its text as a JSON text.
    """
    envelope = F.from_json("document", "pos bigint, listing string")
    rows = lines.select(
        "source", "source_ord", "file",
        F.lit(FEED_OK).alias("feed_status"),
        envelope.alias("envelope"), "document",
    )
    landed = F.col("envelope.pos").isNotNull() & F.col("envelope.listing").isNotNull()
    return rows.select(
        "source", "source_ord", "file", "feed_status",
        F.when(landed, F.col("envelope.pos")).otherwise(F.lit(-1)).alias("pos"),
        F.when(landed, F.col("envelope.listing"))
        .otherwise(as_json_text(F.col("document"))).alias("payload"),
    )


def as_raw(documents: DataFrame, layout: str) -> DataFrame:
    rows = _array_documents(documents) if layout == "array" else _line_records(documents)
    return _shaped(rows)


def _shaped(rows: DataFrame) -> DataFrame:
    return rows.select(
        *(F.col(f.name).cast(f.dataType) for f in schemas.RAW_LISTING.fields)
    )


def tag(documents: DataFrame, feed: Feed, ordinal: int) -> DataFrame:
    """Attach the feed's name and its place in the registry."""
    return documents.select(
        F.lit(feed.name).alias("source"),
        F.lit(ordinal).alias("source_ord"),
        F.col("_metadata.file_path").alias("file"),
        F.col("value").alias("document"),
    )


def read_feed(spark: SparkSession, feed: Feed, ordinal: int) -> DataFrame:
    """Raw listings of one feed; a feed that cannot be opened gives one failure marker."""
    try:
        if feed.layout == "array":
            return _shaped(read_arrays(spark, feed.path).select(
                F.lit(feed.name).alias("source"), F.lit(ordinal).alias("source_ord"), "*"
            ))
        documents = spark.read.text(feed.path)
    except AnalysisException:
        return failed_feed(spark, feed, ordinal)
    return as_raw(tag(documents, feed, ordinal), feed.layout)


def failed_feed(spark: SparkSession, feed: Feed, ordinal: int) -> DataFrame:
    marker = [(feed.name, ordinal, feed.path, None, FEED_FAILED, None)]
    return spark.createDataFrame(marker, schemas.RAW_LISTING)


def read_feeds(spark: SparkSession, registry: Sequence[Feed]) -> DataFrame:
    """Every feed of the registry, in registry order; a failed feed does not stop the others."""
    parts = [read_feed(spark, feed, ordinal) for ordinal, feed in enumerate(registry)]
    return union_all(parts)


def land_as_lines(raw: DataFrame, path: str) -> None:
    """Write the objects of feeds of one source in the ``lines`` layout, with their positions."""
    line = F.concat(
        F.lit('{"pos":'), F.col("pos").cast("string"), F.lit(',"listing":'), "payload", F.lit("}")
    )
    raw.filter(F.col("payload").isNotNull()).select(line.alias("value")).write.text(path)


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda left, right: left.unionByName(right), parts)


def feed_status(raw: DataFrame) -> DataFrame:
    """One row per feed file: whether it was read, and how many listings it held."""
    return raw.groupBy("source", "source_ord", "file").agg(
        F.count("pos").alias("listings"),
        F.count_if(F.col("feed_status") == FEED_FAILED).alias("_failed"),
    ).select(
        "source", "source_ord", "file",
        F.when(F.col("_failed") > 0, FEED_FAILED).otherwise(FEED_OK).alias("status"),
        "listings",
    )
