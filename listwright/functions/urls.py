"""URL parts and the applicant-tracking provider and tenant they point to."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from listwright.fixed_values import ATS_HOSTS, ATS_LABEL_NOISE

_SCHEME = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?"
# Leading control characters and blanks never belong to a URL.
_LEADING = "".join(map(chr, range(0x21)))


def _clean(url: Column) -> Column:
    return F.ltrim(F.translate(url, "\t\r\n", ""), F.lit(_LEADING))


def host(url: Column) -> Column:
    """Lowercase host without user info and port; empty when the URL names none."""
    authority = F.regexp_extract(_clean(url), _SCHEME + r"//([^/?#]*)", 1)
    without_user = F.substring_index(authority, "@", -1)
    # A bracketed address is never a provider host, so it is treated like a missing one.
    named = F.when(without_user.rlike(r"[\[\]]"), F.lit("")).otherwise(
        F.substring_index(without_user, ":", 1)
    )
    return F.lower(named)


def path_segments(url: Column) -> Column:
    """Non-empty path segments, case kept; parameters of the last segment are not part of it."""
    path = F.regexp_extract(_clean(url), _SCHEME + r"(?://[^/?#]*)?([^?#]*)", 1)
    bare = F.regexp_replace(path, r";[^/]*\z", "")
    return F.filter(F.split(bare, "/"), lambda segment: segment != "")


def _matches(host_col: Column, how: str, value: str) -> Column:
    return host_col == value if how == "exact" else host_col.endswith(value)


def _case(branches: Sequence[tuple[Column, Column]]) -> Column:
    chain = F
    for condition, value in branches:
        chain = chain.when(condition, value)
    return chain.otherwise(F.lit(None).cast("string"))


def provider_of(host_col: Column, rules: Sequence[tuple] = ATS_HOSTS) -> Column:
    """Provider whose rule matches the host, or null."""
    return _case([(_matches(host_col, how, value), F.lit(name)) for name, how, value, _ in rules])


def token_of(host_col: Column, segments: Column, rules: Sequence[tuple] = ATS_HOSTS) -> Column:
    """Tenant token for the matching provider, or null."""

    def token(name: str, where: str) -> Column:
        if where == "path":
            return F.get(segments, F.lit(0))
        if where == "none":
            return F.lit(None).cast("string")
        label = F.substring_index(host_col, ".", 1)
        noise = ATS_LABEL_NOISE.get(name)
        return F.replace(label, F.lit(noise), F.lit("")) if noise else label

    return _case(
        [(_matches(host_col, how, value), token(name, where)) for name, how, value, where in rules]
    )
