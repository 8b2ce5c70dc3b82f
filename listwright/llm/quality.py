"""Quality rules, line first: lines that fail a rule go, then documents that lose too much of their text.

A line fails if it is
* symbols: over 0.3 of `[#*$%&|<>{}~^=\\\\]` a word,
* shouting: over 0.2 of `!!` a word, or five or more words without a lower-case ASCII letter,
* navigation: two or more separators that stand alone (| » > · •), or fewer than ten words without
  punctuation at the end,
* boilerplate: at most 25 words with a license, copyright, cookie, subscription or log-in phrase,
* repetition: ten or more words, of which fewer than three in ten differ.
A document is kept if its remaining lines hold at least `keep_part` of its words.

The statistics are per row, in DataFrame functions; nothing is shuffled. Equal three-word windows
are found by sorting 64-bit hashes with their places.

Defined cases: null, empty and wordless texts have no words and fail the base; their counts are 0.
Repeated rows give repeated rows. Null ids pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from listwright.llm.base import spaced_words

LEAST_WORDS = 50
#: Percent of words in repeated windows beyond which the base fails.
MOST_REPEATED = 50
KEEP_PART = 0.5

SYMBOLS = r"[#*$%&|<>{}~^=\\]"
SEPARATED = r" [|»>·•] "
BOILERPLATE = (
    r"(?i)all rights reserved|licensed under|released under|copyright|©|terms of (use|service)|privacy policy"
    r"|cookie|subscribe|newsletter|sign (up|in)|log ?in\b"
)
SENTENCE_END = r"[.!?:;…\"'”’»)\]。！？]\s*$"


def line_fails(line: Column, words: Column, n: Column) -> Column:
    """Whether a line, given its words and their number, fails a rule."""
    symbols = F.regexp_count(line, F.lit(SYMBOLS)) > 0.3 * n
    shouting = (F.regexp_count(line, F.lit("!!")) > 0.2 * n) | (
        (n >= 5) & ~line.rlike("[a-z]") & line.rlike("[A-Z]{2}")
    )
    navigation = (F.regexp_count(line, F.lit(SEPARATED)) >= 2) | ((n < 10) & ~line.rlike(SENTENCE_END))
    boilerplate = (n <= 25) & line.rlike(BOILERPLATE)
    repetition = (n >= 10) & (F.size(F.array_distinct(words)) < 0.3 * n)
    return symbols | shouting | navigation | boilerplate | repetition


def _lines(docs: DataFrame, *columns: str) -> DataFrame:
    """Adds `lines`: of each line its text, its words, their number and whether it fails."""
    texts = F.split(F.coalesce("text", F.lit("")), "\n")
    cut = docs.select(*columns, "text", F.transform(texts, lambda line: F.struct(
        line.alias("line"), spaced_words(line).alias("words"),
    )).alias("cut"))
    return cut.select(*columns, "text", F.transform("cut", lambda e: F.struct(
        e["line"].alias("line"), e["words"].alias("words"), F.size(e["words"]).alias("n"),
        line_fails(e["line"], e["words"], F.size(e["words"])).alias("fails"),
    )).alias("lines"))


def cleaned(docs: DataFrame, keep_part: float = KEEP_PART) -> DataFrame:
    """doc_id, the text without failing lines, and whether the document keeps enough of it.

    Lines without a word are kept as they are.
    """
    rows = _lines(docs, "doc_id")
    stays = F.filter("lines", lambda e: ~e["fails"] | (e["n"] == 0))
    left = F.aggregate("lines", F.lit(0), lambda n, e: n + F.when(e["fails"], 0).otherwise(e["n"]))
    every = F.aggregate("lines", F.lit(0), lambda n, e: n + e["n"])
    return rows.select(
        "doc_id", F.when(F.col("text").isNotNull(), F.array_join(F.transform(stays, lambda e: e["line"]), "\n")).alias("text"),
        ((every > 0) & (left >= keep_part * every)).alias("kept"),
    )


def statistics(docs: DataFrame, keep_part: float = KEEP_PART) -> DataFrame:
    """doc_id, the counts of the base rules, base_failed and kept for every row."""
    rows = _lines(docs, "doc_id").select(
        "doc_id", "text", "lines", F.flatten(F.transform("lines", lambda e: e["words"])).alias("words"),
    )
    rows = rows.select(
        "doc_id", "words", F.transform("words", lambda w: F.xxhash64(w)).alias("h"),
        F.transform(F.filter("lines", lambda e: e["n"] > 0), lambda e: e["line"]).alias("worded"),
        F.regexp_count(F.coalesce("text", F.lit("")), F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.aggregate("lines", F.lit(0), lambda n, e: n + F.when(e["fails"], 0).otherwise(e["n"])).alias("left"),
    )
    starts = F.sequence(F.lit(0), F.size("h") - 3)
    rows = rows.select(
        "doc_id", "n_symbols", "left",
        F.size("words").cast("long").alias("n_words"), F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.size("worded") - F.size(F.array_distinct("worded"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("h") >= 3, F.transform(
            starts, lambda i: F.xxhash64(F.get("h", i), F.get("h", i + 1), F.get("h", i + 2))
        )).alias("windows"),
    )
    counts = ["doc_id", "n_symbols", "left", "n_words", "word_chars", "n_dup_lines"]
    rows = rows.select(*counts, F.when(
        F.size(F.array_distinct("windows")) < F.size("windows"),
        F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
    ).alias("ordered"))
    repeated = F.filter("ordered", lambda e, i: (
        F.get("ordered", i - 1)["h"].eqNullSafe(e["h"]) | F.get("ordered", i + 1)["h"].eqNullSafe(e["h"])
    ))
    rows = rows.select(*counts, F.sort_array(F.transform(repeated, lambda e: e["i"])).alias("places"))
    covered = F.aggregate(
        "places", F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda a, p: F.struct((a["n"] + p + 3 - F.greatest(p, a["end"])).alias("n"), (p + 3).alias("end")),
        lambda a: a["n"],
    )
    rows = rows.select(*counts, F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        (~failed & (F.col("left") >= keep_part * F.col("n_words"))).alias("kept"),
    )
