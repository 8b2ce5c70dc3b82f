"""Reading JSON arrays that are larger than a task should read.

A file is read in byte ranges, cut at every closing brace, so each fragment knows only its own text.
Whether it begins inside a text, and how deep, follows from what precedes it:

1. Each fragment counts its quotes, and its brackets for either case: the range begins outside or
   inside a text. These sum up to one row per range (`range_starts`).
2. The rows of a file's ranges are combined in order: the quotes before a range say which case
   holds, and so how deep it begins.
3. Within its range, a fragment whose brace closes depth two outside a text ends an element. What
   lies between two such ends is parsed as a list of its own; only the pieces before the first and
   after the last end of a range are put together with their neighbours'.

Only step 3 moves text: once, by range. Positions are the elements before the range plus those
before in it. A file that is not exactly one array leaves a marker, as with any other reader; one
whose quotes or brackets do not add up is never put together. What must fit one row is an element
and what follows the element before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from listwright.functions.payload import evaluated_once
from listwright.sources.elements import FEED_FAILED, FEED_OK, element_texts
from listwright.sources.scratch import scratch_dir

_BLANK = r"[ \t\n\r]*"
_RANGE = ("file", "block")


def _file() -> Column:
    return F.replace(F.col("_metadata.file_path"), F.lit(":///"), F.lit(":/"))


def _depth(text: Column) -> Column:
    opened = F.length(text) - F.length(F.translate(text, "[{", ""))
    closed = F.length(text) - F.length(F.translate(text, "]}", ""))
    return opened - closed


def fragments(lines: DataFrame) -> DataFrame:
    """file, block, id (in order within the block), value, and its quotes and brackets.

    `even` is the depth gained if the fragment begins outside a text, `odd` if inside.
    """
    parts = F.split(F.regexp_replace("value", r"(?s)\\.", ""), '"', -1)
    return lines.select(
        _file().alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.col("_metadata.file_size").alias("file_size"), F.monotonically_increasing_id().alias("id"),
        "value", (F.size(parts) - 1).alias("quotes"),
        _depth(F.array_join(F.filter(parts, lambda _, i: i % 2 == 0), "")).alias("even"),
        _depth(F.array_join(F.filter(parts, lambda _, i: i % 2 == 1), "")).alias("odd"),
    )


def _before(total: Column, window) -> Column:
    earlier = window.rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(total).over(earlier), F.lit(0))


def range_starts(cut: DataFrame) -> DataFrame:
    """file, block, its parity and depth where it begins, whether it is first or last, and if the file adds up."""
    order = Window.partitionBy(*_RANGE).orderBy("id")
    start = _before(F.col("quotes"), order) % 2
    end = (_before(F.col("quotes"), order) + F.col("quotes")) % 2

    def gained(case: int) -> Column:
        inside = start == 1 - case
        return F.when(inside, F.col("odd")).otherwise(F.col("even")) - F.when(end == case, 1).otherwise(0)

    each = cut.select(
        *_RANGE, "file_size", "id", "quotes", F.octet_length("value").alias("bytes"),
        gained(0).alias("outside"), gained(1).alias("inside"),
    )
    ranges = each.groupBy(*_RANGE).agg(
        F.max("file_size").alias("file_size"), F.max("id").alias("last_id"), F.sum("quotes").alias("quotes"),
        F.sum(F.col("bytes") + 1).alias("bytes"), F.sum("outside").alias("outside"), F.sum("inside").alias("inside"),
    )
    along, whole = Window.partitionBy("file").orderBy("block"), Window.partitionBy("file")
    placed = ranges.withColumn("parity", (_before(F.col("quotes"), along) % 2).cast("int")).withColumn(
        "gained", F.when(F.col("parity") == 0, F.col("outside")).otherwise(F.col("inside"))
    )
    # No brace follows the last fragment, so the file has one byte less and is one level deeper than
    # counted. One that ends with a brace is no array. A byte order mark is not part of the text.
    braced = (F.col("file_size") - F.sum("bytes").over(whole)).isin(0, 3)
    adds_up = (F.sum("quotes").over(whole) % 2 == 0) & (F.sum("gained").over(whole) == -1) & ~braced
    return placed.select(
        *_RANGE, "parity", _before(F.col("gained"), along).alias("depth"), "last_id",
        F.lag("block").over(along).isNull().alias("first"), F.lead("block").over(along).isNull().alias("last"),
        adds_up.alias("adds_up"),
    )


def _groups(cut: DataFrame, starts: DataFrame) -> DataFrame:
    """Text between two ends of elements, by range: file, block, g, text, and where it lies."""
    rows = cut.join(starts.filter("adds_up"), list(_RANGE))
    order = Window.partitionBy(*_RANGE).orderBy("id")
    outside = (F.col("parity") + _before(F.col("quotes"), order)) % 2 == 0
    ends_outside = (F.col("parity") + _before(F.col("quotes"), order) + F.col("quotes")) % 2 == 0
    final = F.col("last") & (F.col("id") == F.col("last_id"))
    gained = F.when(outside, F.col("even")).otherwise(F.col("odd")) - F.when(ends_outside & ~final, 1).otherwise(0)
    stated = rows.select(*_RANGE, "id", "value", "first", "depth", final.alias("final"), gained.alias("gained"),
                         ends_outside.alias("ends_outside"))
    deep = F.col("depth") + F.sum("gained").over(order.rowsBetween(Window.unboundedPreceding, 0))
    ended = stated.withColumn("ends", ~F.col("final") & F.col("ends_outside") & (deep == 1))
    numbered = ended.withColumn("g", _before(F.col("ends").cast("int"), order))
    braced = F.concat("value", F.when(F.col("final"), F.lit("")).otherwise(F.lit("}")))
    gathered = numbered.select(*_RANGE, "g", "id", braced.alias("value"), "first", "final", "ends").groupBy(*_RANGE, "g").agg(
        F.sort_array(F.collect_list(F.struct("id", "value"))).alias("values"),
        F.max("first").alias("first"), F.max("final").alias("final"), F.max("ends").alias("ends"),
    )
    text = F.array_join(F.transform("values", lambda v: v["value"]), "")
    return gathered.select(*_RANGE, "g", text.alias("text"), (F.col("first") & (F.col("g") == 0)).alias("first"), "final", "ends")


def _listed(text: Column, first: Column, final: Column) -> Column:
    """The text between ends of elements as a list of its own, or null if it cannot be one."""
    opened = F.when(~first, text).when(text.rlike(rf"^{_BLANK}\["), F.regexp_replace(text, rf"^{_BLANK}\[", ""))
    inner = F.when(~final, opened).when(opened.rlike(rf"\]{_BLANK}$"), F.regexp_replace(opened, rf"\]{_BLANK}$", ""))
    blank = inner.rlike(rf"^{_BLANK}$")
    following = F.when(inner.rlike(rf"^{_BLANK},"), F.regexp_replace(inner, rf"^{_BLANK},", ""))
    following = F.when(~following.rlike(rf"^{_BLANK}$"), following)
    rest = F.when(first, inner).when(final & blank, F.lit("")).otherwise(following)
    return F.concat(F.lit("["), rest, F.lit("]"))


def _parsed(groups: DataFrame, *keep: str) -> DataFrame:
    """`elements`, texts of the group's elements; null for a group that is no list."""
    listed = groups.select(*keep, evaluated_once(_listed(F.col("text"), F.col("first"), F.col("final"))).alias("document"))
    return element_texts(listed, *keep)


def read_arrays(spark: SparkSession, path: str) -> DataFrame:
    """file, feed_status, pos and payload of every element of the array files under a path.

    Files that are one range each, as Spark would read them, are parsed whole; the rows are the same.
    """
    lines = spark.read.option("lineSep", "}").text(path)
    sizes = _sizes(spark, lines.inputFiles())
    range_bytes = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    whole = all(size <= range_bytes for _, size in sizes)
    return _read_whole(spark, path, sizes) if whole else read_ranges(spark, lines)


def _sizes(spark: SparkSession, files: list[str]) -> list[tuple[str, int]]:
    """Name and length of the files that the driver has listed to plan the scan."""
    jvm, conf, found = spark._jvm, spark._jsc.hadoopConfiguration(), []
    for name in files:
        place = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(name))
        found.append((_file_name(name), place.getFileSystem(conf).getFileStatus(place).getLen()))
    return found


def _file_name(name: str) -> str:
    return name.replace(":///", ":/")


def _read_whole(spark: SparkSession, path: str, sizes: list[tuple[str, int]]) -> DataFrame:
    documents = spark.read.text(path, wholetext=True).select(_file().alias("file"), F.col("value").alias("document"))
    rows = element_texts(documents, "file").select(
        "file", F.when(F.col("elements").isNull(), FEED_FAILED).otherwise(FEED_OK).alias("feed_status"),
        F.posexplode_outer("elements").alias("pos", "payload"),
    ).withColumn("pos", F.col("pos").cast("bigint"))
    empty = [(name, FEED_FAILED, None, None) for name, size in sizes if not size]
    return rows.union(spark.createDataFrame(empty, rows.schema)) if empty else rows


def read_ranges(spark: SparkSession, lines: DataFrame) -> DataFrame:
    """`read_arrays` by byte ranges, of files read with a closing brace as the end of a line.

    The tables between the steps are written; those with a row per range are small.
    """
    cut, folder = fragments(lines), scratch_dir(spark, "array")

    def written(rows: DataFrame, name: str) -> DataFrame:
        rows.write.parquet(f"{folder}/{name}")
        return spark.read.schema(rows.schema).parquet(f"{folder}/{name}")

    ranges = written(range_starts(cut), "ranges")
    # A piece at the edge of its range waits for its neighbours; the rest is parsed where it is.
    edge = (F.col("g") == 0) | ~F.col("ends")
    groups = _groups(cut, ranges).withColumn("edge", edge).withColumn("own", F.when(edge, F.col("text")))
    inner = _parsed(groups.withColumn("text", F.when(~edge, F.col("text"))), *_RANGE, "g", "edge", "first", "final", "ends", "own")
    count = F.when(F.col("edge"), 0).otherwise(F.coalesce(F.size("elements"), F.lit(0)))
    pieces = written(inner.withColumn("before", _before(count, Window.partitionBy(*_RANGE).orderBy("g"))), "pieces")
    chains = written(_chains(pieces), "chains")
    # A file without a byte has no range.
    listed = spark.createDataFrame([(_file_name(name),) for name in lines.inputFiles()], "file string")
    bases = written(_bases(listed, ranges, pieces, chains), "bases")
    return _placed(bases, pieces, chains)


def _chains(pieces: DataFrame) -> DataFrame:
    """Edge pieces put together: file, block and g where they begin, and their elements."""
    edges = pieces.filter("edge").select(*_RANGE, "g", "first", "final", "ends", "own")
    order = Window.partitionBy("file").orderBy("block", "g")
    chained = edges.withColumn("chain", _before(F.col("ends").cast("int"), order)).groupBy("file", "chain").agg(
        F.min(F.struct("block", "g")).alias("at"), F.max("first").alias("first"), F.max("final").alias("final"),
        F.sort_array(F.collect_list(F.struct("block", "g", "own"))).alias("owns"),
    )
    whole = chained.select(
        "file", F.col("at.block").alias("block"), F.col("at.g").alias("g"), "first", "final",
        F.array_join(F.transform("owns", lambda own: own["own"]), "").alias("text"),
    )
    return _parsed(whole, *_RANGE, "g")


def _bases(listed: DataFrame, ranges: DataFrame, pieces: DataFrame, chains: DataFrame) -> DataFrame:
    """By range, the elements before it, at its head and within it; by file, if it failed and what it holds."""
    size, no = F.coalesce(F.size("elements"), F.lit(0)), F.lit(0)
    broken = F.col("elements").isNull()
    counts = pieces.filter("not edge").select(*_RANGE, size.alias("inner"), no.alias("head"), no.alias("tail"), broken.alias("broken")).union(
        chains.select(*_RANGE, no, F.when(F.col("g") == 0, size).otherwise(0), F.when(F.col("g") > 0, size).otherwise(0), broken)
    ).union(ranges.select(*_RANGE, no, no, no, ~F.col("adds_up"))).union(
        listed.select("file", F.lit(None).cast("bigint"), no, no, no, F.lit(False))
    ).groupBy(*_RANGE).agg(*(F.sum(c).alias(c) for c in ("inner", "head", "tail")), F.max("broken").alias("broken"))
    along, whole = Window.partitionBy("file").orderBy("block"), Window.partitionBy("file")
    every = F.col("inner") + F.col("head") + F.col("tail")
    return counts.select(
        *_RANGE, "inner", "head", _before(every, along).alias("base"),
        (F.max("broken").over(whole) | (F.count("block").over(whole) == 0)).alias("failed"), F.sum(every).over(whole).alias("listings"),
    )


def _placed(bases: DataFrame, pieces: DataFrame, chains: DataFrame) -> DataFrame:
    kept = bases.filter("not failed")
    tail = F.when(F.col("g") == 0, F.col("base")).otherwise(F.col("base") + F.col("head") + F.col("inner"))
    found = pieces.filter("not edge").select(*_RANGE, "elements", "before").join(kept, list(_RANGE)).select(
        "file", (F.col("base") + F.col("head") + F.col("before")).alias("start"), "elements"
    ).union(chains.join(kept, list(_RANGE)).select("file", tail, "elements"))
    rows = found.select("file", "start", F.posexplode("elements").alias("i", "payload")).select(
        "file", F.lit(FEED_OK).alias("feed_status"), (F.col("start") + F.col("i")).alias("pos"), "payload"
    )
    # Each listed file has a row without a range.
    markers = bases.filter("block is null and (failed or listings = 0)").select(
        "file", F.when(F.col("failed"), FEED_FAILED).otherwise(FEED_OK).alias("feed_status"),
        F.lit(None).cast("bigint").alias("pos"), F.lit(None).cast("string").alias("payload"),
    )
    return rows.unionByName(markers)
