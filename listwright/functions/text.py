"""Text folding: stripping, company keys, fingerprints, ids and version hashes."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, functions as F

from listwright.fixed_values import COMPANY_SUFFIXES, CONFIG_VERSION_HEX, FINGERPRINT_HEX

# The characters counted as white space around a text.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

_ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def strip(text: Column) -> Column:
    """Remove Unicode white space at both ends (one linear pass, no regular expression)."""
    return F.btrim(text, F.lit(WHITESPACE))


def strip_lower(text: Column) -> Column:
    return strip(F.lower(text))


def ascii_lower(text: Column) -> Column:
    """Fold A-Z only, as a case-insensitive LIKE does."""
    return F.translate(text, _ASCII_UPPER, _ASCII_UPPER.lower())


def or_null(text: Column) -> Column:
    """Empty text becomes null."""
    return F.nullif(text, F.lit(""))


def or_default(text: Column, default: str) -> Column:
    """Null or empty text becomes `default`."""
    return F.coalesce(or_null(text), F.lit(default))


def company_key(name: Column, suffixes: tuple[str, ...] = COMPANY_SUFFIXES) -> Column:
    """Lookup key of a company: lower case, stripped, legal-form suffixes removed.

    Each suffix is tried once, in order, on what the earlier ones left. The fold keeps the
    expression linear in the number of suffixes.
    """

    def drop(text: Column, suffix: Column) -> Column:
        rest = F.left(text, F.length(text) - F.length(suffix))
        return F.when(F.endswith(text, suffix), strip(rest)).otherwise(text)

    return F.aggregate(F.array(*map(F.lit, suffixes)), strip_lower(name), drop)


def sha256_prefix(text: Column, digits: int) -> Column:
    return F.left(F.sha2(text.cast("binary"), 256), F.lit(digits))


def fingerprint(key: Column, title: Column, locations: Column) -> Column:
    """Content hash of a listing that is the same whichever feed it came from."""
    places = F.array_join(F.array_sort(F.transform(locations, strip_lower)), "|")
    return sha256_prefix(
        F.concat(key, F.lit("::"), strip_lower(title), F.lit("::"), places), FINGERPRINT_HEX
    )


def natural_id(*parts: Column) -> Column:
    """Stable id of a natural key: 128 bits of SHA-256 over the length-prefixed parts.

    A 64-bit hash would be expected to collide at about five billion keys; this one does not, and
    unlike a sequence it needs no coordination between tasks.
    """
    pieces = [p for part in parts for p in (F.length(part).cast("string"), F.lit(":"), part)]
    return sha256_prefix(F.concat(*pieces), 32)


def version_hash(content: Column) -> Column:
    """Version of a config document stored in a table."""
    return sha256_prefix(content, CONFIG_VERSION_HEX)


def version_of_bytes(content: bytes) -> str:
    """Version of a config document read on the driver."""
    return hashlib.sha256(content).hexdigest()[:CONFIG_VERSION_HEX]
