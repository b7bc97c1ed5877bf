"""Company names as column expressions: keys, suffixes, repeats, initials."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Corporate suffixes, in the order in which they are taken off.
SUFFIXES = (r"\bInc\.?\b", r"\bLtd\.?\b", r"\bCorp\.?\b", r"\bGroup\b", r"\bCo\.?\b", r"\bPLC\b", r"\bCorporation\b", r"\bLimited\b", r"\bS\.A\.?\b", r"\bA\.G\.?\b", r"\bN\.V\.?\b", r"\bB\.V\.?\b")


def let(value: Column, use) -> Column:
    """use(value), with the value computed once: an expression that uses its argument often would grow with each nesting."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def compact_key(name: Column) -> Column:
    """Lower case, other than letters and digits one space, trimmed; empty for null."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), "[^a-z0-9]+", " "))


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def _bare(word: Column) -> Column:
    """A word as it is compared: lower case, without full stops and commas at its ends."""
    return F.regexp_replace(F.lower(word), r"^[.,]+|[.,]+$", "")


def collapse_repeats(name: Column) -> Column:
    """Takes off a beginning of up to four words that is said twice; failing that, words that repeat their predecessor."""
    return let(F.filter(F.split(name, r"\s+"), lambda w: w != ""), _collapsed)


def _collapsed(words: Column) -> Column:
    n = F.size(words)

    def said_twice(k: int) -> Column:
        first, second = F.slice(words, 1, k), F.slice(words, k + 1, k)
        bare = lambda part: F.regexp_replace(F.lower(F.array_join(part, " ")), r"^[.,]+|[.,]+$", "")
        return (n >= 2 * k) & (bare(first) != "") & (bare(first) == bare(second))

    deduped = F.array_join(F.filter(words, lambda w, i: (i == 0) | (_bare(w) != _bare(F.get(words, i - 1)))), " ")
    out = F.when(n < 2, F.array_join(words, " "))
    for k in (4, 3, 2, 1):
        out = out.when(said_twice(k), F.array_join(F.slice(words, k + 1, n), " "))
    return out.otherwise(deduped)


def normalize_name(name: Column) -> Column:
    """Without corporate suffixes, repeats and trailing punctuation; empty for null."""
    clean = lambda x: F.trim(F.regexp_replace(squeezed(x), r"[,.]+$", ""))
    out = collapse_repeats(clean(F.coalesce(name, F.lit(""))))
    for suffix in SUFFIXES:
        out = F.trim(F.regexp_replace(out, f"(?i){suffix}", ""))
    return collapse_repeats(clean(out))


def initials(name: Column) -> Column:
    """First letters of the words that begin with a letter, in upper case."""
    words = F.filter(F.split(name, r"[\s-]+"), lambda w: F.substring(w, 1, 1).rlike(r"^\p{L}"))
    return F.upper(F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), ""))


def is_abbreviation(short: Column, long: Column) -> Column:
    s = F.replace(F.upper(short), F.lit("."), F.lit(""))
    return (s != "") & (s == initials(long))


def slug(text: Column, gap: str = "_") -> Column:
    """A file name: lower case, words joined by the gap."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[^\w\s]", ""), r"\s+", gap)


def canonical_variants(canonical: str) -> list[str]:
    """Other ways to write a canonical name, by its suffix."""
    out = []
    if canonical.endswith("Inc."):
        out.append(canonical[:-1])
    if canonical.endswith(", Inc."):
        out += [canonical.replace(", Inc.", ""), canonical.replace(", Inc.", " Inc")]
    if canonical.endswith("Co., Ltd."):
        out += [canonical.replace("Co., Ltd.", "Co Ltd"), canonical.replace(" Co., Ltd.", "")]
    return out
