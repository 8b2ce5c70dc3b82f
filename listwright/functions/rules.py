"""Rule lists compiled to single regular expressions, and the tier they decide."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from listwright.fixed_values import (
    KEYWORD_PATTERNS, NAMED_COMPANIES, SKIP_PATTERNS, TIER_KEYWORD, TIER_NAMED, TIER_SKIP,
)

# Any case in any script; "." stops at a line feed only.
_FLAGS = "(?iud)"
# Letters, digits and underscore of any script, spelled out because the meaning of \b differs
# between Java versions.
_WORD = r"[\p{L}\p{N}_]"
_BOUNDARY = rf"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))"


def _spell_boundaries(pattern: str) -> str:
    return pattern.replace(r"\b", _BOUNDARY)


def any_literal(terms: Iterable[str]) -> str:
    """One expression matching any of the terms as whole words."""
    options = "|".join(re.escape(t) for t in dict.fromkeys(terms))
    return f"{_FLAGS}{_BOUNDARY}(?:{options}){_BOUNDARY}"


def any_pattern(patterns: Iterable[str]) -> str:
    r"""One expression matching any of the patterns.

    Patterns of the form \b...\b share one boundary test, so the boundary is checked once per
    position of the text and not once per pattern.
    """
    bounded, free = [], []
    for pattern in dict.fromkeys(patterns):
        whole = re.fullmatch(r"\\b(.*)\\b", pattern)
        (bounded if whole else free).append(whole.group(1) if whole else pattern)
    options = [f"(?:{_spell_boundaries(p)})" for p in free]
    if bounded:
        inner = "|".join(_spell_boundaries(p) for p in bounded)
        options.append(f"{_BOUNDARY}(?:{inner}){_BOUNDARY}")
    return _FLAGS + "|".join(options)


@dataclass(frozen=True)
class TierRules:
    named: tuple[str, ...] = NAMED_COMPANIES
    keywords: tuple[str, ...] = KEYWORD_PATTERNS
    skips: tuple[str, ...] = SKIP_PATTERNS

    def is_named(self, company: Column) -> Column:
        return _search(F.lower(company), any_literal(self.named), self.named)

    def is_skipped(self, title: Column) -> Column:
        return _search(title, any_pattern(self.skips), self.skips)

    def is_keyword(self, company: Column, title: Column) -> Column:
        return _search(_blob(company, title), any_pattern(self.keywords), self.keywords)

    def tier(self, company: Column, title: Column) -> Column:
        """Named company first, then title exclusions, then keywords, then skip."""
        return (
            F.when(self.is_named(company), F.lit(TIER_NAMED))
            .when(self.is_skipped(title), F.lit(TIER_SKIP))
            .when(self.is_keyword(company, title), F.lit(TIER_KEYWORD))
            .otherwise(F.lit(TIER_SKIP))
        )

    def matched_terms(self, company: Column, title: Column) -> Column:
        """Distinct terms, in order of appearance, that decided the tier."""
        tier = self.tier(company, title)
        return (
            F.when(tier == TIER_NAMED, _found(F.lower(company), any_literal(self.named)))
            .when(tier == TIER_KEYWORD,
                  _found(_blob(company, title), any_pattern(self.keywords)))
            .otherwise(_found(title, any_pattern(self.skips)) if self.skips else _no_terms())
        )


def _blob(company: Column, title: Column) -> Column:
    return F.concat(company, F.lit(" "), title)


def _search(text: Column, expression: str, rules: tuple[str, ...]) -> Column:
    return text.rlike(expression) if rules else F.lit(False)


def _no_terms() -> Column:
    return F.array().cast("array<string>")


def _found(text: Column, expression: str) -> Column:
    hits = F.regexp_extract_all(text, F.lit(expression), F.lit(0))
    return F.array_distinct(F.transform(hits, lambda hit: F.lower(hit)))
