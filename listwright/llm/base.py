"""What the operators of this package share: words, row keys and written intermediate tables."""

from __future__ import annotations

import string
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

UPPER, LOWER = string.ascii_uppercase, string.ascii_lowercase
#: Characters 1 to 47, 58 to 96 and 123 to 127, and 0: what separates words of letters, digits and
#: characters beyond ASCII.
SEPARATORS = "".join(chr(c) for c in (*range(48), *range(58, 97), *range(123, 128)))
WHITE = r"[\x20\x09-\x0D]+"

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share, `spark.checkpoint.dir`.

    Where that is unset, a session on one machine takes a path beside its warehouse; a cluster has no
    folder that all executors see, so there it is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.conf.get("spark.master", "").startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}-scratch"
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Remove a table that `shared_path` named and nothing reads any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def shuffles_dropped(spark: SparkSession):
    """Within, an action's shuffle files go when it ends instead of when the driver collects garbage."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def written(frame: DataFrame, name: str) -> DataFrame:
    """The frame as a table in the shared folder: its lineage ends there, so a lost executor costs
    no more than the tasks it was running."""
    spark = frame.sparkSession
    path = shared_path(spark, name)
    with shuffles_dropped(spark):
        frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def bucketed(frame: DataFrame, name: str, key: str) -> DataFrame:
    """`written`, as a table bucketed by a key: what is joined with it by that key comes to its buckets,
    and its own rows are never shuffled."""
    spark = frame.sparkSession
    path = shared_path(spark, name)
    table_name = path.rsplit("/", 1)[1].replace("-", "_")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    with shuffles_dropped(spark):
        frame.write.bucketBy(buckets, key).option("path", path).saveAsTable(table_name)
    return spark.table(table_name)


def fresh(frame: DataFrame, *names: str) -> list[str]:
    """Column names like those given that the frame does not have."""
    taken = {c.lower() for c in frame.columns}
    found = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        found.append(name)
    return found


def keyed(docs: DataFrame, *more: Column) -> DataFrame:
    """`doc_id`, and `mark`, a hash of the text: together what tells rows of documents apart.

    Rows that agree in both are copies with one id and get equal results.
    """
    return docs.select("doc_id", F.xxhash64("text").alias("mark"), *more)


def same_row(left: DataFrame, right: DataFrame) -> Column:
    return left["doc_id"].eqNullSafe(right["doc_id"]) & (left["mark"] == right["mark"])


def without(docs: DataFrame, losers: DataFrame) -> DataFrame:
    """Rows of documents whose key is not among `losers` (doc_id, mark). Columns stay as they are."""
    mark, = fresh(docs, "mark")
    left = docs.withColumn(mark, F.xxhash64("text"))
    gone = losers.select(F.col("doc_id").alias("_gone_id"), F.col("mark").alias("_gone_mark"))
    kept = left.join(
        gone, left["doc_id"].eqNullSafe(gone["_gone_id"]) & (left[mark] == gone["_gone_mark"]), "left_anti"
    )
    return kept.select(*(F.col(f"`{c}`") for c in docs.columns))


def spaced_words(text: Column) -> Column:
    """Words between white space (characters 9 to 13 and 32); none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WHITE), "")


def folded_words(text: Column) -> Column:
    """Words of letters, digits and characters beyond ASCII, A-Z lower-cased; none for null."""
    flat = F.translate(F.coalesce(text, F.lit("")), UPPER + SEPARATORS, LOWER + " " * len(SEPARATORS))
    return F.array_remove(F.split(flat, " "), "")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
