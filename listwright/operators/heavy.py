"""The most frequent values of a column, exactly, without shuffling every rare one.

Rows are first counted by bucket, a hash of the value: a few rows per task, whatever the column. No
value is more frequent than its bucket, so the buckets' counts bound what any value can reach. The
values of the fullest buckets are counted exactly; the k-th of them is a count that the answer reaches
at least, and only buckets that reach it too are counted in the end. Where counts are nearly even, that
is most of them, and the work is that of counting every value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from listwright.sources.scratch import scratch_dir

BUCKETS = 1 << 16


def _bucket(value: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col(value)), F.lit(buckets))


def _counted(rows: DataFrame, value: str, seq: Column, buckets: int, chosen: DataFrame) -> DataFrame:
    """Exact counts of the values in chosen buckets; there are at most `buckets` of these."""
    marked = rows.withColumn("_bucket", _bucket(value, buckets))
    return marked.join(F.broadcast(chosen.select("_bucket")), "_bucket", "left_semi").groupBy(value).agg(
        F.count("*").alias("n"), F.min(seq).alias("_first")
    )


def most_common_bounded(rows: DataFrame, value: str, seq: Column, k: int, buckets: int = BUCKETS) -> DataFrame:
    """The k most frequent values, null included; ties go to the value seen first."""
    spark = rows.sparkSession
    path = scratch_dir(spark, "bucket-counts")
    rows.groupBy(_bucket(value, buckets).alias("_bucket")).agg(F.count("*").alias("_total")).write.parquet(path)
    totals = spark.read.schema("_bucket bigint, _total bigint").parquet(path)
    fullest = totals.orderBy(F.desc("_total"), "_bucket").limit(k)
    reached = _counted(rows, value, seq, buckets, fullest).orderBy(F.desc("n")).limit(k).agg(
        F.when(F.count("*") == k, F.min("n")).otherwise(0)
    ).first()[0]
    counted = _counted(rows, value, seq, buckets, totals.filter(F.col("_total") >= reached))
    return counted.orderBy(F.desc("n"), F.asc("_first")).limit(k).drop("_first")
