"""Benchmark decontamination as a prefix-filtered set join, in DataFrame operations only.

A window is `window` consecutive words of a benchmark item, or the whole item if it has fewer. Its
set is that of its word shingles (`shingle` words, or the whole window if it has fewer). As a
document contains a window only if it holds all its shingles, the necessary prefix is one shingle:
the rarest, by its count over all documents. Documents that hold it at a place that leaves room
for the window on both sides are candidates; a candidate stands if every shingle of the window is
there at its own place, which is exact containment, as neighbouring shingles overlap.

Document shingles are first held against a bitmap of `bitmap_bits` bits, the only broadcast table,
of at most `bitmap_bits` / 64 rows however large the benchmark; what passes is joined by its words.

Defined cases: null and wordless texts have no words and are never hit; items without a word have
no windows; repeated items and rows change nothing; a null item_id is not listed or counted,
though its windows hit. With an empty benchmark nothing is contaminated. The digest of no items is
that of the empty string.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from listwright.llm.base import folded_words, keyed, same_row, without, written

WINDOW = 13
SHINGLE = 3
BITMAP_BITS = 1 << 23
#: A document is contaminated if this part of its words, one in so many, is hit.
HIT_PART = 20


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """item_id and the words of each of its windows."""
    words = benchmark.select("item_id", folded_words(F.col("text")).alias("words")).filter("size(words) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - window + 1, F.lit(1)))
    return words.select(
        "item_id", F.explode(F.transform(starts, lambda i: F.slice("words", i, window))).alias("words")
    ).distinct()


def _joined(words: list[Column]) -> Column:
    return F.concat_ws(" ", *words)


def window_shingles(windows: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """Each distinct window (its words as text), its length, and each of its shingles with its place."""
    width = F.least(F.lit(shingle), F.size("words"))
    each = windows.select("words").distinct().select(
        F.array_join("words", " ").alias("window"), F.size("words").alias("length"), width.alias("width"), "words"
    )
    places = F.sequence(F.lit(0), F.col("length") - F.col("width"))
    return each.select(
        "window", "length", "width",
        F.posexplode(F.transform(places, lambda i: F.slice("words", i + 1, F.col("width")))).alias("offset", "own"),
    ).select(
        "window", "length", "width", "offset", F.array_join("own", " ").alias("shingle"),
        F.xxhash64(*(F.get("own", F.lit(i)) for i in range(shingle))).alias("h"),
    )


def _cell(h: Column, bits: int) -> Column:
    return F.shiftright(h.bitwiseAND(F.lit(bits - 1)), 6)


def bitmap(hashes: DataFrame, bits: int = BITMAP_BITS) -> DataFrame:
    """cell and its 64 bits, for the cells with a bit: at most `bits` / 64 rows."""
    bit = F.expr("shiftleft(1L, cast(h & 63 as int))")
    return hashes.select(_cell(F.col("h"), bits).alias("cell"), bit.alias("bit")).groupBy("cell").agg(
        F.bit_or("bit").alias("set_bits")
    )


def document_shingles(docs: DataFrame, known: DataFrame, shingle: int = SHINGLE,
                      bits: int = BITMAP_BITS) -> DataFrame:
    """doc_id, mark, n_words and place of every shingle of documents that is among the known ones."""
    widths = sorted(r["width"] for r in known.select("width").distinct().collect())  # at most `shingle` rows
    columns = [f"w{i}" for i in range(shingle)]
    words = keyed(docs, folded_words(F.col("text")).alias("words")).filter("size(words) > 0")
    shifted = [F.slice("words", i + 1, F.size("words")).alias(c) for i, c in enumerate(columns)]
    rows = words.select("doc_id", "mark", F.size("words").alias("n_words"), *shifted).select(
        "doc_id", "mark", "n_words", F.posexplode(F.arrays_zip(*columns)).alias("place", "own")
    )
    own = [F.col(f"own.{c}") for c in columns]
    keys = [
        F.struct(F.lit(n).alias("width"), F.xxhash64(*own[:n]).alias("h"), _joined(own[:n]).alias("shingle"))
        for n in widths
    ] or [F.struct(F.lit(0).alias("width"), F.lit(0).cast("long").alias("h"), F.lit("").alias("shingle"))]
    if len(keys) == 1:
        rows = rows.select("doc_id", "mark", "n_words", "place", keys[0]["width"].alias("width"),
                           keys[0]["h"].alias("h"), keys[0]["shingle"].alias("shingle"))
    else:
        rows = rows.select("doc_id", "mark", "n_words", "place", F.inline(F.array(*keys)))
    set_bits = F.broadcast(bitmap(known.select("h"), bits))
    possible = rows.withColumn("cell", _cell(F.col("h"), bits)).join(set_bits, "cell").filter(
        "(set_bits & shiftleft(1L, cast(h & 63 as int))) <> 0 and place + width <= n_words"
    )
    return possible.join(known.select("shingle", "width", "id"), ["shingle", "width"]).select(
        "doc_id", "mark", "n_words", "place", "id"
    ).distinct()


def occurrences(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, mark, start, length and window: every place where a window occurs."""
    placed = written(window_shingles(item_windows(benchmark, window), shingle), "window-shingles")
    known = written(
        placed.groupBy("shingle", "width").agg(F.first("h").alias("h")).withColumn("id", F.xxhash64("shingle", "width")),
        "shingles",
    )
    there = written(document_shingles(docs, known, shingle), "document-shingles")
    rarity = there.groupBy("id").count()
    ranked = placed.withColumn("id", F.xxhash64("shingle", "width")).join(rarity, "id", "left")
    size = F.max("offset") + 1
    prefix = written(
        ranked.groupBy("window", "length").agg(
            F.min(F.struct(F.coalesce("count", F.lit(0)).alias("count"), "id", "offset")).alias("rarest"),
            size.alias("n"), F.sort_array(F.collect_list(F.struct("offset", "id"))).alias("every"),
        ).filter("rarest.count > 0")
        .select("window", "length", "n", "every", F.col("rarest.id").alias("id"), F.col("rarest.offset").alias("offset")),
        "prefixes",
    )
    candidates = there.join(prefix, "id").withColumn("start", F.col("place") - F.col("offset")).filter(
        "start >= 0 and start + length <= n_words"
    )
    wanted = candidates.select("doc_id", "mark", "start", "length", "window", "n", F.inline("every")).select(
        "doc_id", "mark", "start", "length", "window", "n", "id", (F.col("start") + F.col("offset")).alias("place")
    )
    met = wanted.join(
        there, wanted["doc_id"].eqNullSafe(there["doc_id"]) & (wanted["mark"] == there["mark"])
        & (wanted["place"] == there["place"]) & (wanted["id"] == there["id"]), "left_semi",
    )
    return met.groupBy("doc_id", "mark", "start", "length", "window", "n").count().filter("count = n").select(
        "doc_id", "mark", "start", "length", "window"
    )


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, mark, number of words hit and the items that occur, for documents with a hit."""
    found = written(occurrences(docs, benchmark, window, shingle), "occurrences")
    row = Window.partitionBy("doc_id", "mark").orderBy("start", "length")
    before = F.coalesce(F.max(F.col("start") + F.col("length")).over(row.rowsBetween(Window.unboundedPreceding, -1)),
                        F.lit(0))
    new = F.greatest(F.col("start") + F.col("length") - F.greatest("start", before), F.lit(0))
    covered = found.select("doc_id", "mark", "start", "length").distinct().select("doc_id", "mark", new.alias("new"))
    n_hit = covered.groupBy("doc_id", "mark").agg(F.sum("new").alias("n_hit"))
    owners = item_windows(benchmark, window).select(
        F.col("item_id").cast("string").alias("item_id"), F.array_join("words", " ").alias("window")
    ).distinct()
    items = found.select("doc_id", "mark", "window").distinct().join(owners, "window").groupBy("doc_id", "mark").agg(
        F.array_sort(F.collect_set("item_id")).alias("items")
    )
    return n_hit.join(items, same_row(n_hit, items), "left").select(
        n_hit["doc_id"], n_hit["mark"], n_hit["n_hit"], items["items"]
    )


def judged(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, mark, n_words, n_hit, items and contaminated, for every row of documents."""
    found = written(hits(docs, benchmark, window, shingle), "hits")
    rows = keyed(docs, F.size(folded_words(F.col("text"))).cast("long").alias("n_words"))
    n_hit = F.coalesce(found["n_hit"], F.lit(0)).cast("long")
    return rows.join(found, same_row(rows, found), "left").select(
        rows["doc_id"], rows["mark"], "n_words", n_hit.alias("n_hit"),
        F.coalesce(found["items"], F.array().cast("array<string>")).alias("items"),
        ((n_hit > 0) & (HIT_PART * n_hit >= rows["n_words"])).alias("contaminated"),
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """Documents that are not contaminated, columns unchanged."""
    found = judged(docs, benchmark, window, shingle)
    return without(docs, written(found.filter("contaminated").select("doc_id", "mark").distinct(), "contaminated"))
