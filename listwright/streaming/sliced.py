"""Streams of several micro-batches over files in arrival order, and a fold that may be repeated."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from listwright.operators.merge import MergeSpec, fold


def land_in_slices(rows: DataFrame, slice_of: Column, folder: str) -> int:
    """Write rows as one file per slice, dated in the order of the slices; returns their number.

    A file stream takes files by their time, so one file per trigger gives one slice per micro-batch.
    """
    spark = rows.sparkSession
    rows.withColumn("slice", slice_of.cast("int")).repartition("slice").write.partitionBy("slice").parquet(folder)
    jvm = spark._jvm
    place = jvm.org.apache.hadoop.fs.Path(folder)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    slices = sorted(
        (int(status.getPath().getName().split("=")[1]), status.getPath())
        for status in system.listStatus(place) if "=" in status.getPath().getName()
    )
    for number, (_, path) in enumerate(slices):
        for status in system.listStatus(path):
            system.setTimes(status.getPath(), 1_000_000_000_000 + 60_000 * number, -1)
    return len(slices)


def read_slices(spark: SparkSession, folder: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """Slices as a stream, some files per micro-batch, oldest first."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{folder}/slice=*")


def fold_stream(
    sightings: DataFrame, spec: MergeSpec, folder: str, checkpoint: str,
    after: Callable[[int], None] = lambda batch_id: None,
) -> StreamingQuery:
    """Fold every micro-batch into the state that the one before it left, then stop.

    Micro-batch n writes the state after it to a folder of its own, from that of n - 1, which it never
    changes. One that is repeated, because the run died before its checkpoint was written, so writes the
    same state again, and no log of what was merged is needed. Folders before n - 1 are removed.
    """
    spark, schema = sightings.sparkSession, sightings.schema

    def body(batch: DataFrame, batch_id: int) -> None:
        rows = batch
        if batch_id:
            rows = spark.read.schema(schema).parquet(f"{folder}/batch={batch_id - 1}").unionByName(batch)
        fold(rows, spec).write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")
        _remove(spark, f"{folder}/batch={batch_id - 2}")
        after(batch_id)

    return (
        sightings.writeStream.foreachBatch(body).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def folded_state(spark: SparkSession, folder: str, schema) -> DataFrame:
    """The state after the last micro-batch that was written whole."""
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [status.getPath().getName() for status in system.listStatus(place)]
    done = [n for n in (int(name.split("=")[1]) for name in names if name.startswith("batch="))
            if system.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/batch={n}/_SUCCESS"))]
    return spark.read.schema(schema).parquet(f"{folder}/batch={max(done)}")


def _remove(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def first_slice_of(rows: DataFrame, value: str, slices: int) -> Column:
    """Slices of equal width over the range of a whole-number column."""
    low, high = rows.agg(F.min(value), F.max(value)).first()
    if low is None:
        return F.lit(0)
    return F.floor((F.col(value) - low) * slices / (high - low + 1))
