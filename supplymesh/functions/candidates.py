"""Names of candidate suppliers as column expressions: cleaning, validation, acceptance."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from supplymesh.functions.names import compact_key, let, squeezed
from supplymesh.functions.text import strip_markup
from supplymesh.sources import reference_data as R

_CORPORATE = rf"(?i)\b(?:{R.CORPORATE})\b"
_SHORT_CORPORATE = r"(?i)\b(?:Inc|Ltd|Corp|Group|Co|PLC|Corporation|Limited)\b"


def any_pattern(text: Column, patterns) -> Column:
    return F.coalesce(text.rlike("|".join(f"(?:{p})" for p in patterns)), F.lit(False))


def clean(name: Column) -> Column:
    """Without markup, quotes and brackets around, trailing punctuation, and a leading article."""
    out = squeezed(strip_markup(name))
    out = F.regexp_replace(out, r"""^["'`({\[]+""", "")
    out = F.regexp_replace(out, r"""["'`)}\],.;:]+$""", "")
    return F.trim(F.regexp_replace(out, r"(?i)^(?:the|a|an)\s+", ""))


def is_place(name: Column) -> Column:
    return let(clean(name), _is_place)


def _is_place(c: Column) -> Column:
    return (c != "") & (compact_key(c).isin(R.LOCATIONS) | any_pattern(F.lower(c), R.PLACE_PATTERNS))


def is_product(name: Column) -> Column:
    return compact_key(name).isin(R.PRODUCTS)


def company_span(text: Column) -> Column:
    """The first run of capitalised words that ends in a corporate suffix, else the first of up to four; null if there is none."""
    return let(clean(text), _company_span)


def _company_span(t: Column) -> Column:
    suffixed = F.regexp_extract(t, rf"\b([A-Z][A-Za-z0-9&.\-']*(?:\s+[A-Z][A-Za-z0-9&.\-']*)*\s+(?:{R.CORPORATE}))\b", 1)
    titled = F.regexp_extract(t, r"\b([A-Z][A-Za-z0-9&.\-']*(?:\s+[A-Z][A-Za-z0-9&.\-']*){0,3})\b", 1)
    return F.when(suffixed != "", clean(suffixed)).when(titled != "", clean(titled))


def dedupe_prefix(name: Column) -> Column:
    """Without a beginning that is said twice; the first word alone if it is also the last of three or more."""
    return let(F.split(name, r"\s+"), _without_prefix)


def _without_prefix(words: Column) -> Column:
    n = F.size(words)
    bare = lambda x: F.regexp_replace(F.lower(x), r"^[.,]+|[.,]+$", "")
    out = F.when((n >= 3) & (bare(F.get(words, F.lit(0))) == bare(F.get(words, n - 1))), F.get(words, F.lit(0)))
    for k in (4, 3, 2, 1):
        first, second = F.array_join(F.slice(words, 1, k), " "), F.array_join(F.slice(words, k + 1, k), " ")
        out = out.when((n >= 2 * k) & (bare(first) != "") & (bare(first) == bare(second)), F.array_join(F.slice(words, k + 1, n), " "))
    return out.otherwise(F.array_join(words, " "))


def rejection(name: Column, known: Column, target_variants: Column | None = None) -> Column:
    """Why a cleaned name is no supplier's; null if it may be one. ``known``: whether it is a known organisation.
    ``target_variants``: compact names of the company whose suppliers are looked for."""
    return let(clean(name), lambda c: _rejection(c, known, target_variants))


def _rejection(c: Column, known: Column, target_variants: Column | None) -> Column:
    low, key = F.lower(c), compact_key(c)
    words = F.regexp_extract_all(c, F.lit(r"[A-Za-z0-9&.\-']+"), F.lit(0))
    meaning = F.filter(words, lambda w: ~F.replace(F.lower(w), F.lit("."), F.lit("")).isin(R.GENERIC))
    one = F.get(words, F.lit(0))
    capital = c.rlike(r"^[A-Z0-9]")
    identifiable = (F.length(c) >= 3) & (
        known
        | (
            ~low.isin(R.GENERIC) & ~F.exists(F.array(*map(F.lit, R.FRAGMENTS)), lambda p: F.contains(low, p)) & c.rlike("[A-Za-z]") & capital & (F.size(meaning) > 0)
            & ~((F.size(meaning) == 1) & F.lower(F.get(meaning, F.lit(0))).isin(R.PRODUCTS))
            & (
                c.rlike(_CORPORATE)
                | F.when((F.size(words) == 1) & (F.upper(one) == one) & one.rlike("[A-Z]") & (F.length(one) >= 2), True)
                .when((F.size(words) == 1) & (F.length(one) < 4), False)
                .when(F.size(words) > 4, False)
                .otherwise(F.exists(meaning, lambda w: w.rlike("^[A-Z]") | (F.upper(w) == w)))
            )
        )
    )
    out = (
        F.when(F.coalesce(c, F.lit("")) == "", "empty candidate")
        .when(key.isin(R.INVALID), "known malformed or non-organization candidate")
        .when(key.isin(R.PERSONS), "person name, not an organization")
        .when(key.isin(R.PRODUCTS), "product or brand name, not an organization")
        .when(_is_place(c), "location, region, or ecosystem label, not a supplier company")
        .when(any_pattern(low, R.GENERIC_PATTERNS), "generic or malformed organization phrase")
        .when(low.rlike(r"\b(?:that|currently|while|including|such as)\b") & ~known, "sentence fragment rather than organization name")
        .when(c.rlike(r"[^A-Za-z0-9&\s.\-',]"), "unsupported punctuation")
        .when(~identifiable, "not an identifiable organization")
    )
    if target_variants is not None:
        flat = lambda x: F.regexp_replace(F.lower(x), "[^a-z0-9]", "")
        same = F.array_contains(target_variants, key) | F.exists(target_variants, lambda t: (F.get(target_variants, F.lit(0)) == t) & (flat(t) != "") & (F.contains(flat(c), flat(t)) | F.contains(flat(t), flat(c))))
        out = out.when(F.coalesce(same, F.lit(False)), "candidate is the source company")
    return out


def candidate_name(raw: Column) -> Column:
    """The organisation named in a fragment of text about a relationship, cleaned; it still has to be validated."""
    return let(clean(raw), _candidate_name)


def _candidate_name(c: Column) -> Column:
    lead = F.coalesce(*(F.nullif(F.regexp_extract(c, f"(?i){p}", 1), F.lit("")) for p in (r"^(.+?)\s+became\s+(?:a\s+)?(?:major\s+)?supplier\s+to\b", r"^(.+?)\s+is\s+a\s+business\s+unit\s+of\b", r"^(.+?)\s+supplier\s+to\b")))
    trail = F.coalesce(*(F.nullif(F.regexp_extract(c, f"(?i){p}", 1), F.lit("")) for p in (r"\bmanufacturing\s+including\s+(.+)$", r"\bincluding\s+(.+)$", r"\bsuch\s+as\s+(.+)$", r"\bwith\s+(.+)$")))
    out = dedupe_prefix(let(F.coalesce(lead, trail, c), lambda part: F.coalesce(company_span(part), clean(part))))
    return clean(F.regexp_replace(out, r"(?i)\s+(?:became|including|supplier\s+to|is\s+a\s+business\s+unit\s+of)\b.*$", ""))


def supplier_name_rejection(name: Column, confidence: Column, known: Column, least: float = 0.75) -> Column:
    """Why a discovered name isn't taken; null if it is."""
    return let(F.struct(F.trim(name).alias("c"), rejection(name, known).alias("why")), lambda x: _supplier_rejection(x["c"], x["why"], confidence, least))


def _supplier_rejection(c: Column, why: Column, confidence: Column, least: float) -> Column:
    return (
        F.when(confidence < least, "Low confidence")
        .when(F.coalesce(F.length(c), F.lit(0)) < 3, "Too short")
        .when(c.rlike(r"[?.!;:]+$"), "Looks like a sentence fragment or title")
        .when(F.lower(c).isin(R.PLACEHOLDERS), "Generic placeholder")
        .when(why.isNotNull(), why)
        .when(F.lower(c).rlike(r"\b(?:and|for|of|by|with|from|about)\b") & ~c.rlike(_SHORT_CORPORATE), "Likely sentence fragment or relationship phrase")
        .when(c.rlike(r"[^A-Za-z0-9&\s.\-',]"), "Contains unsupported punctuation or symbols")
        .when(~c.rlike("^[A-Z0-9]"), "Does not resemble an organization name")
        .when(~c.rlike(r"\s") & (F.length(c) < 4) & ~c.rlike(_SHORT_CORPORATE), "Single-word name looks too short to be valid")
    )
