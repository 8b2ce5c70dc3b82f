"""JSON arrays as lists of the texts of their elements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from listwright.functions.payload import evaluated_once

FEED_OK, FEED_FAILED = "ok", "failed"


def as_json_text(text: Column) -> Column:
    """A text as JSON, so that it is read as a text and not as what it may hold."""
    return F.regexp_extract(F.to_json(F.array(text)), r"(?s)^\[(.*)\]$", 1)


def element_texts(documents: DataFrame, *keep: str) -> DataFrame:
    """`elements` of each row's `document`: JSON texts of its elements, null if it is not one array.

    The document is parsed inside an object, because a bare list reader stops at the closing bracket
    and would not notice text after it.
    """
    wrapped = F.concat(F.lit('{"listings":'), F.col("document"), F.lit(',"end":true}'))
    parsed = F.from_json(
        wrapped, "listings array<string>, end boolean, broken string",
        {"columnNameOfCorruptRecord": "broken"},
    )
    # A text among the elements loses its quotes above and would pass for the object it may hold.
    typed = F.from_json(wrapped, "listings array<variant>")["listings"]
    split = documents.select(*keep, evaluated_once(F.struct(parsed.alias("texts"), typed.alias("typed"))).alias("parsed"))
    texts = F.col("parsed.texts")
    whole = texts["broken"].isNull() & F.coalesce(texts["end"], F.lit(False))
    quoted = F.transform("parsed.typed", lambda element: F.coalesce(F.schema_of_variant(element) == "STRING", F.lit(False)))
    elements = F.transform(
        F.arrays_zip(texts["listings"].alias("text"), quoted.alias("quoted")),
        lambda element: F.when(element["quoted"], as_json_text(element["text"])).otherwise(element["text"]),
    )
    return split.select(*keep, F.when(whole, elements).alias("elements"))
