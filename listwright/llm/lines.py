"""Line deduplication with overlapping windows of three lines.

A window is three consecutive lines that have a word. As a passage can be fewer, longer lines, one
line or two consecutive lines with `long_words` words or more are windows too; lines without a word
are neither compared nor removed. Windows are counted over the whole table by a 128-bit hash. The
first occurrence, by (doc_id, text hash, place), stays; lines covered by any later one go, whether
in the same document or in another. So a line goes only if an earlier equal line exists.

Defined cases: null text stays null, and a text whose lines all go becomes empty; rows are never
dropped. A null `doc_id` sorts first. Rows that agree in id and text are one document: all stay or
lose the same lines. Other columns pass through; `n_chars`, where there is one, is set anew.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from listwright.llm.base import fresh, keyed, same_row, spaced_words, written

WINDOW_LINES = 3
LONG_WORDS = 50


def _line(line: Column, place: Column) -> Column:
    return F.struct(
        place.alias("place"), F.size(spaced_words(line)).alias("words"),
        F.xxhash64(line).alias("h"), F.xxhash64(F.lit("second"), line).alias("g"),
    )


def windows(docs: DataFrame, long_words: int = LONG_WORDS) -> DataFrame:
    """doc_id, mark, start (index among lines with a word), h, g and the covered line numbers."""
    lines = F.transform(F.split("text", "\n"), _line)
    worded = keyed(docs, lines.alias("lines")).select(
        "doc_id", "mark", F.filter("lines", lambda line: line["words"] > 0).alias("lines")
    )
    shifted = [F.slice("lines", n + 1, F.greatest(F.size("lines"), F.lit(1))).alias(f"l{n}") for n in range(WINDOW_LINES)]
    rows = worded.select("doc_id", "mark", *shifted).select(
        "doc_id", "mark", F.posexplode(F.arrays_zip("l0", "l1", "l2"))
    )

    def window(n: int) -> Column:
        own = [F.col(f"col.l{i}") for i in range(n)]
        long = sum((line["words"] for line in own), F.lit(0)) >= long_words
        wanted = own[-1].isNotNull() & (F.lit(True) if n == WINDOW_LINES else long)
        return F.when(wanted, F.struct(
            F.xxhash64(F.lit(n), *(line["h"] for line in own)).alias("h"),
            F.xxhash64(F.lit(n), *(line["g"] for line in own)).alias("g"),
            F.array(*(line["place"] for line in own)).alias("covers"),
        ))

    each = F.array_compact(F.array(*(window(n) for n in range(1, WINDOW_LINES + 1))))
    return rows.select("doc_id", "mark", F.col("pos").alias("start"), F.inline(each))


def later_lines(docs: DataFrame, long_words: int = LONG_WORDS) -> DataFrame:
    """doc_id, mark and the numbers (from 0) of lines that later occurrences cover."""
    found = windows(docs, long_words)
    place = F.struct("doc_id", "mark", "start")
    repeated = written(
        found.groupBy("h", "g").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first"))
        .filter("n > 1").select("h", "g", "first"),
        "repeated-windows",
    )
    later = found.join(repeated, ["h", "g"]).filter(
        ~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("mark") == F.col("first.mark"))
          & (F.col("start") == F.col("first.start")))
    )
    covered = later.select("doc_id", "mark", F.explode("covers").alias("line")).distinct()
    return covered.groupBy("doc_id", "mark").agg(F.collect_list("line").alias("lines"))


def _kept(text: Column, lines: Column) -> Column:
    every = F.split(text, "\n")
    stay = F.array_except(F.sequence(F.lit(0), F.size(every) - 1), lines)
    return F.array_join(F.transform(stay, lambda i: F.get(every, i)), "\n")


def deduplicated(docs: DataFrame, long_words: int = LONG_WORDS) -> DataFrame:
    """Documents with their text less the covered lines, and `n_chars` to match."""
    mark, = fresh(docs, "mark")
    # Shuffled at every size: the other side grows with the table.
    gone = written(later_lines(docs, long_words), "later-lines").hint("merge").select(
        F.col("doc_id").alias("_gone_id"), F.col("mark").alias("_gone_mark"), F.col("lines").alias("_gone_lines")
    )
    left = docs.withColumn(mark, F.xxhash64("text"))
    joined = left.join(
        gone, left["doc_id"].eqNullSafe(gone["_gone_id"]) & (left[mark] == gone["_gone_mark"]), "left"
    )
    text = F.when(gone["_gone_lines"].isNull(), left["text"]).otherwise(_kept(left["text"], gone["_gone_lines"]))
    columns = {c: left[f"`{c}`"] for c in docs.columns} | {"text": text}
    if "n_chars" in columns:
        kind = docs.schema["n_chars"].dataType
        length = F.when(gone["_gone_lines"].isNull(), left["n_chars"]).otherwise(F.length(text))
        columns["n_chars"] = length.cast(kind)
    return joined.select(*(value.alias(name) for name, value in columns.items()))


def report(docs: DataFrame, long_words: int = LONG_WORDS) -> DataFrame:
    """doc_id, n_lines, n_removed and the remaining text of every row."""
    rows = keyed(docs, "text")
    gone = written(later_lines(docs, long_words), "later-lines").hint("merge")
    joined = rows.join(gone, same_row(rows, gone), "left")
    count = F.coalesce(F.size(F.split(rows["text"], "\n")), F.lit(0))
    return joined.select(
        rows["doc_id"],
        F.when(rows["text"].isNull(), 0).otherwise(count).cast("long").alias("n_lines"),
        F.when(gone["lines"].isNull(), 0).otherwise(F.size(gone["lines"])).cast("long").alias("n_removed"),
        F.when(gone["lines"].isNull(), rows["text"]).otherwise(_kept(rows["text"], gone["lines"])).alias("text"),
    )
