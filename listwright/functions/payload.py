"""Reading JSON fields that may be absent, null or of an unexpected type.

A field is held as VARIANT: SQL null when absent, a variant null when present and null.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# JSON texts, other than the empty text, that count as false. Every number equal to zero is written
# as one of the zeros.
FALSY = ("null", "false", "0", "0.0", "-0.0", "[]", "{}")


def _variants(names: tuple[str, ...]) -> str:
    return ", ".join(f"{name} variant" for name in names)


def parse_fields(text: Column, names: tuple[str, ...]) -> Column:
    """Struct of the named top-level fields of a JSON object, and ``broken`` if it is not one.

    One pass over the text; fields that are not named are skipped without being built.
    """
    schema = f"{_variants(names)}, broken string"
    return F.from_json(text, schema, {"columnNameOfCorruptRecord": "broken"})


def parse_single_object(text: Column, names: tuple[str, ...]) -> Column:
    """List of objects to be read with `single_object`.

    The JSON reader stops after the first value, so text that follows it would go unnoticed. The
    text is read as the first item of a list that ends with a marker: the marker is the second item
    only if nothing else follows.
    """
    marked = F.concat(F.lit("["), text, F.lit(',{"end":true}]'))
    return F.from_json(marked, f"array<struct<{_variants(names)}, end boolean>>")


def single_object(listed: Column) -> Column:
    """The fields of a text that was exactly one JSON object, else null."""
    marker = F.get(listed, F.lit(1))["end"]
    return F.when((F.size(listed) == 2) & F.coalesce(marker, F.lit(False)), F.get(listed, F.lit(0)))


def evaluated_once(value: Column) -> Column:
    """The value as a generator of one row.

    Filters are pushed below a projection by repeating the projected expression, which for a parse
    means parsing again for every use. They are not pushed below a generator.
    """
    return F.explode(F.array(value))


def is_kind(node: Column, *kinds: str) -> Column:
    """Type test by the variant's own schema: STRING, BOOLEAN, BIGINT, ARRAY, OBJECT, VOID..."""
    actual = F.substring_index(F.schema_of_variant(node), "<", 1)
    return F.coalesce(actual.isin(*kinds), F.lit(False))


def is_truthy(node: Column, when_absent: bool = False) -> Column:
    """False for null, false, zero, empty text, empty list and empty object; else true."""
    # Texts are compared as they are; writing a long one as JSON would copy it letter by letter.
    truth = F.when(F.schema_of_variant(node) == "STRING", as_text(node) != "").otherwise(
        ~F.to_json(node).isin(*FALSY)
    )
    return F.coalesce(truth, F.lit(when_absent))


def as_text(node: Column) -> Column:
    return F.try_variant_get(node, "$", "string")


def as_long(node: Column) -> Column:
    return F.try_variant_get(node, "$", "bigint")


def as_strings(node: Column) -> Column:
    """A list of texts; an absent, null or empty value is the empty list, another type is null."""
    empty = F.array().cast("array<string>")
    return F.when(is_truthy(node), F.try_variant_get(node, "$", "array<string>")).otherwise(empty)
