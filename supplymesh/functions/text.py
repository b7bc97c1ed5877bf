"""Text as column expressions: markup, phrases, sentences, labels."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Character references decoded without Python; anything rarer stays as it is.
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&#x27;": "'", "&apos;": "'", "&copy;": "©", "&middot;": "·", "&amp;": "&"}


def strip_markup(text: Column) -> Column:
    """Without tags, with common character references decoded, white space collapsed."""
    out = F.regexp_replace(F.coalesce(text, F.lit("")), r"<[^>]+>", " ")
    for entity, plain in ENTITIES.items():
        out = F.replace(out, F.lit(entity), F.lit(plain))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def phrase_regex(phrase: Column | str) -> Column:
    """A pattern that finds a phrase as a whole, in any case: no letter or digit before or after."""
    quoted = F.lit(re.escape(phrase)) if isinstance(phrase, str) else F.concat(F.lit(r"\Q"), phrase, F.lit(r"\E"))
    return F.concat(F.lit("(?i)(?<![A-Za-z0-9])"), quoted, F.lit("(?![A-Za-z0-9])"))


def contains_phrase(text: Column, phrase: Column | str) -> Column:
    given = F.lit(phrase) if isinstance(phrase, str) else phrase
    return F.coalesce((given != "") & F.regexp_like(text, phrase_regex(phrase)), F.lit(False))


def phrase_count(text: Column, phrase: Column | str) -> Column:
    return F.regexp_count(text, phrase_regex(phrase))


def mentions_any(text: Column, phrases: Column) -> Column:
    """Whether any phrase of an array is in the text as a whole."""
    return F.exists(phrases, lambda p: contains_phrase(text, p))


def matched(text: Column, terms: list[str] | tuple[str, ...]) -> Column:
    """Those of the terms that the lower-cased text has anywhere, also within words."""
    low = F.lower(text)
    return F.filter(F.array(*map(F.lit, terms)), lambda t: F.contains(low, t))


def has_any(text: Column, terms: list[str] | tuple[str, ...]) -> Column:
    """Whether the lower-cased text has any of the terms anywhere, also within words."""
    return F.coalesce(F.lower(text).rlike("|".join(re.escape(t) for t in terms)), F.lit(False)) if terms else F.lit(False)


def hits(text: Column, patterns: list[str] | tuple[str, ...]) -> Column:
    """How many of the patterns the text matches."""
    out = F.lit(0)
    for p in patterns:
        out = out + F.coalesce(text.rlike(p), F.lit(False)).cast("int")
    return out


def sentences(text: Column) -> Column:
    return F.split(text, r"(?<=[.!?])\s+")


def truncated(text: Column, limit: int) -> Column:
    """At most so many characters; the last three of a text that is cut are dots."""
    return F.when(F.length(text) > limit, F.concat(F.rtrim(F.left(text, F.lit(limit - 3))), F.lit("..."))).otherwise(text)


def display_label(value: Column) -> Column:
    """snake_case as title case; empty for null."""
    return F.initcap(F.replace(F.coalesce(value, F.lit("")), F.lit("_"), F.lit(" ")))
