"""Evidence of supply in text snippets as column expressions: signals, direction, gate, classification.

Evidence is an array of structs (title, link, snippet); variants are arrays of ways to write a name.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from supplymesh.functions.candidates import is_product
from supplymesh.functions.names import compact_key, let
from supplymesh.functions.text import contains_phrase, hits, strip_markup
from supplymesh.sources import reference_data as R

_ANYWHERE = lambda patterns: [f"(?iU){p}" for p in patterns]
# Weights of signals, least scores by tier, least scores and confidences elsewhere; words that say who supplies whom.
WEIGHTS, LEAST_BY_TIER, LEAST_SCORE, LEAST_CONFIDENCE, LEAST_DISCOVERY = (5, 3, 1), {2: 3, 3: 5}, 5, 0.65, 0.75
_VERBS = r"(?:suppl(?:y|ies|ied)|provid(?:e|es|ed)|manufactur(?:e|es|ed)|fabricat(?:e|es|ed)|assembl(?:e|es|ed)|packag(?:e|es|ed)|sells?)"
_BY = r"(?:supplied by|sourced from|sources from|procures from|manufactured by|fabricated by|assembled by|packaged by|outsourced to)"
_ROLES = r"(?:supplier|vendor|component\s+supplier|materials?\s+supplier|equipment\s+supplier|foundry|osat|packaging\s+partner|assembly\s+partner|assembler|contract\s+manufacturer|manufacturing\s+partner|original\s+design\s+manufacturer|odm)"
_THINGS = r"(?:components?|parts?|chips?|materials?|equipment|systems?|foundry|assembly|packaging|manufacturing)"
_CUSTOMER = r"(?:customer|client|buyer|brand|product\s+line|device\s+model|joint\s+venture|competitor)"


def whole_text(evidence: Column) -> Column:
    """Titles and snippets of all items, as plain lower-cased text."""
    each = F.transform(F.coalesce(evidence, F.array().cast("array<struct<title:string,link:string,snippet:string>>")), lambda e: F.concat_ws(" ", e["title"], e["snippet"]))
    return F.lower(strip_markup(F.array_join(each, " ")))


def snippets(evidence: Column) -> Column:
    return F.array_join(F.transform(evidence, lambda e: F.coalesce(e["snippet"], F.lit(""))), " ")


def analysed_text(text: Column) -> Column:
    """Signals in one lower-cased text: struct(strong, medium, weak, against)."""
    return F.struct(hits(text, _ANYWHERE(R.STRONG)).alias("strong"), hits(text, _ANYWHERE(R.MEDIUM)).alias("medium"), hits(text, _ANYWHERE(R.WEAK)).alias("weak"), hits(text, ["|".join(f"(?:{p})" for p in _ANYWHERE(R.AGAINST))]).alias("against"))


def item_texts(evidence: Column) -> Column:
    """Title and snippet of each item that has any, as plain text."""
    return F.transform(F.filter(evidence, lambda e: F.trim(F.concat_ws(" ", e["title"], e["snippet"])) != ""), lambda e: strip_markup(F.concat_ws(" ", e["title"], e["snippet"])))


def analysis(evidence: Column) -> Column:
    """Signals in all items: struct(strong, medium, weak, negative, supporting, score). Distinct patterns count once in each item."""
    return totals(F.transform(item_texts(evidence), lambda t: let(F.lower(t), analysed_text)))


def totals(each: Column) -> Column:
    """Signals by item, added up."""
    zero = F.struct(*(F.lit(0).alias(n) for n in ("strong", "medium", "weak", "negative", "supporting")))
    total = F.aggregate(F.coalesce(each, F.array().cast("array<struct<strong:int,medium:int,weak:int,against:int>>")), zero, lambda t, x: F.struct(
        (t["strong"] + x["strong"]).alias("strong"), (t["medium"] + x["medium"]).alias("medium"), (t["weak"] + x["weak"]).alias("weak"),
        (t["negative"] + x["against"]).alias("negative"), (t["supporting"] + (x["strong"] + x["medium"] + x["weak"] > 0).cast("int")).alias("supporting"),
    ))
    scored = lambda t: t.withField("score", WEIGHTS[0] * t["strong"] + WEIGHTS[1] * t["medium"] + WEIGHTS[2] * t["weak"])
    return let(total, scored)


def has_signal(a: Column) -> Column:
    return a["strong"] + a["medium"] + a["weak"] > 0


def mentions(text: Column, variants: Column) -> Column:
    return F.coalesce(F.exists(variants, lambda v: contains_phrase(text, v)), F.lit(False))


def _any_of(variants: Column) -> Column:
    """A pattern for any of the variants as a whole."""
    quoted = F.array_join(F.transform(variants, lambda v: F.concat(F.lit(r"\Q"), v, F.lit(r"\E"))), "|")
    return F.concat(F.lit("(?<![a-z0-9])(?:"), quoted, F.lit(")(?![a-z0-9])"))


def _windowed(text: Column, parts: list[list[Column | str]]) -> Column:
    found = F.lit(False)
    for p in parts:
        found = found | F.regexp_like(text, F.concat(F.lit("(?is)"), *(F.lit(x) if isinstance(x, str) else x for x in p)))
    return F.coalesce(found, F.lit(False))


def links_candidate(text: Column, candidate: Column, source: Column) -> Column:
    """Whether the text says that the candidate supplies the source."""
    c, s = _any_of(candidate), _any_of(source)
    return mentions(text, source) & mentions(text, candidate) & _windowed(text, [
        [c, ".{0,120}" + _VERBS + r".{0,120}\b(?:to|for|used by)\b.{0,80}", s],
        [s, ".{0,120}" + _BY + ".{0,80}", c],
        [s, r".{0,120}\buses?\b.{0,80}", c],
        [c, r".{0,120}\b(?:is|are|was|were|serves?\s+as|acts?\s+as)\b.{0,80}\b(?:a|an|the)?\s*" + _ROLES + r"\b.{0,80}\b(?:to|for|of)\b.{0,80}", s],
        [s, r".{0,120}\b(?:uses?|relies?\s+on|depends?\s+on)\b.{0,100}", c, r".{0,100}\b" + _THINGS + r"\b"],
    ])


def reversed_direction(text: Column, name: Column, candidate: Column, source: Column) -> Column:
    """Whether the text says that the candidate is supplied by, or a customer, brand or rival of, the source."""
    c, s = _any_of(candidate), _any_of(source)
    said = _windowed(text, [
        [s, ".{0,120}" + _VERBS + r".{0,120}\b(?:to|for|used by)\b.{0,80}", c],
        [c, r".{0,80}\b(?:is|are|was|were|as|became)\b.{0,60}\b(?:a|an|the|major|key)?\s*" + _CUSTOMER + r"s?\b.{0,80}\b(?:of|for|to)\b.{0,80}", s],
        [s, r".{0,120}\b(?:customers?|clients?|buyers?|brands?|joint\s+ventures?|competitors?)\b.{0,80}\b(?:include|includes|including|such\s+as|like)\b.{0,80}", c],
    ])
    brand = compact_key(name).isin(R.CUSTOMER_BRANDS) & text.rlike(r"\b(?:customer|client|buyer|brand|product|device)\b")
    return mentions(text, source) & mentions(text, candidate) & (said | brand)


def about_manufacturing(text: Column) -> Column:
    return let(F.lower(strip_markup(text)), _about_manufacturing)


def _about_manufacturing(low: Column) -> Column:
    a = analysed_text(low)
    terms = "|".join(R.MANUFACTURING)
    return F.coalesce(low.rlike(rf"(?<![a-z0-9])(?:{terms})(?![a-z0-9])"), F.lit(False)) | (a["strong"] + a["medium"] + a["weak"] > 0)


def unrelated_energy(name: Column, text: Column, candidate: Column, source: Column) -> Column:
    return name.rlike(r"(?i)\b(?:energy|solar|wind|renewable|power)\b") & ~links_candidate(text, candidate, source)


def gate(evidence: Column, tier: Column, confidence: Column, name: Column | None = None, candidate: Column | None = None, source: Column | None = None) -> Column:
    """struct(accepted, reason): whether evidence carries a relationship in its tier. Without variants of both names direction isn't asked for."""
    return let(gate_signals(evidence, name, candidate, source), lambda x: gate_of(x, tier, confidence))


def gate_signals(evidence: Column, name: Column | None = None, candidate: Column | None = None, source: Column | None = None) -> Column:
    """What gates of any tier look at, worked out once: the analysis, whether there is evidence, and what it says about the two names (null where they aren't given)."""
    known = F.struct(analysis(evidence).alias("a"), whole_text(evidence).alias("text"), F.coalesce(F.size(evidence) > 0, F.lit(False)).alias("some"))
    return let(known, lambda x: F.struct(x["a"].alias("a"), x["some"].alias("some"), *_said(x["text"], name, candidate, source)))


def _said(text: Column, name: Column | None, candidate: Column | None, source: Column | None) -> list[Column]:
    both = candidate is not None and source is not None
    who = name if name is not None else F.get(candidate, F.lit(0)) if candidate is not None else None
    told = {
        "source": None if source is None else mentions(text, source), "candidate": None if candidate is None else mentions(text, candidate),
        "linked": links_candidate(text, candidate, source) if both else None, "reverse": reversed_direction(text, who, candidate, source) if both else None,
    }
    return [(F.lit(None).cast("boolean") if v is None else v).alias(k) for k, v in told.items()]


def gate_of(x: Column, tier: Column, confidence: Column) -> Column:
    """gate() by what gate_signals() gives."""
    a, some = x["a"], x["some"]
    least = F.when(tier == 2, LEAST_BY_TIER[2]).when(tier == 3, LEAST_BY_TIER[3]).otherwise(0)
    label = F.concat(F.lit("Tier-"), tier.cast("string"))
    no = lambda *words: F.struct(F.lit(False).alias("accepted"), F.concat(*(F.lit(w) if isinstance(w, str) else w for w in words)).alias("reason"))
    first = tier == 1
    out = F.when(some & ~x["source"], no("Evidence does not mention the source company for the claimed supplier relationship"))
    out = out.when(some & ~x["candidate"], no("Evidence does not mention the candidate company for the claimed supplier relationship"))
    out = out.when(first & some & ~has_signal(a), no("Evidence does not contain a supplier indicator"))
    out = out.when(first & some & (a["strong"] == 0) & ~x["linked"], no("Evidence does not explicitly establish supplier direction"))
    out = out.when(first & (a["negative"] > 0) & (a["score"] < 5), no("Negative relationship signals outweigh supplier evidence"))
    yes = confidence >= LEAST_DISCOVERY
    out = out.when(first, F.struct(yes.alias("accepted"), F.when(yes, "Accepted tier-1 supplier evidence").otherwise("Low discovery confidence").alias("reason")))
    out = out.when(~some, no(label, " suppliers require evidence score >= ", least.cast("string")))
    out = out.when((a["negative"] > 0) & (a["score"] < least + 3), no(label, " negative relationship signals outweigh supplier evidence score"))
    out = out.when(x["reverse"], no(label, " evidence indicates customer, brand, product, partner, competitor, or reverse-supplier direction"))
    out = out.when(~x["linked"], no(label, " evidence does not explicitly show that the candidate supplies the source company"))
    enough = a["score"] >= least
    shown = F.concat(F.lit("[EVIDENCE SCORE] Tier: "), tier.cast("string"), F.lit(" | Score: "), a["score"].cast("string"), F.lit(" | Threshold: "), least.cast("string"), F.lit(" | Decision: "), F.when(enough, "Accepted").otherwise("Rejected"))
    return out.otherwise(F.struct(enough.alias("accepted"), shown.alias("reason")))


def classify(target: Column, candidate: Column, text: Column, competes: Column) -> Column:
    """struct(relationship_type, confidence_score, reasoning) of a candidate by text; the first rule that fits decides."""
    known = F.struct(F.lower(text).alias("low"), analysis(_one(text)).alias("a"))
    return let(known, lambda x: _classified(target, candidate, x["low"], x["a"], competes))


def _one(text: Column) -> Column:
    return F.array(F.struct(F.lit("").alias("title"), F.lit("").alias("link"), text.alias("snippet")))


def _classified(target: Column, candidate: Column, low: Column, a: Column, competes: Column) -> Column:
    c, t = F.lower(candidate), F.lower(target)
    says = lambda *words: F.contains(low, F.concat(*(F.lit(w) if isinstance(w, str) else w for w in words)))
    result = lambda kind, score, why: F.struct(F.lit(kind).alias("relationship_type"), (F.round(score, 2) if isinstance(score, Column) else F.lit(score)).alias("confidence_score"), F.lit(why).alias("reasoning"))
    score = F.least(F.lit(0.95), 0.62 + a["score"] * 0.035 + a["strong"] * 0.03 + a["supporting"] * 0.02)
    return (
        F.when(is_product(candidate), result("product_or_brand", 0.9, "Candidate appears to be a product or brand, not a supplier company."))
        .when(says(c, " is a subsidiary") | says(c, " is owned by") | says(c, " was acquired by ", t), result("unrelated", 0.82, "Evidence indicates ownership or subsidiary status, not a supplier relationship."))
        .when(says(t, " supplies") | says(t, " provides") | says(c, " is a customer") | says(c, " is a client"), result("customer", 0.78, "Evidence indicates the target sells to the candidate."))
        .when((competes | low.rlike("competitor|rival|competes with")) & (a["score"] < LEAST_SCORE), result("competitor", 0.75, "Evidence indicates a competitor relationship without supplier support."))
        .when(a["score"] >= LEAST_SCORE, result("supplier", score, "Evidence contains direct supplier, manufacturing, foundry, component, or assembly language."))
        .when(a["medium"] > 0, result("partner", 0.58, "Evidence indicates partnership language but not supply direction."))
        .otherwise(result("unrelated", 0.35, "Evidence does not establish a supplier relationship."))
    )


def enforce(result: Column, text: Column, tier: Column) -> Column:
    """A classification after its thresholds, on the first 500 characters, with its label by tier."""
    return let(analysis(_one(F.left(text, F.lit(500)))), lambda a: _enforced(result, a, tier))


def _enforced(result: Column, a: Column, tier: Column) -> Column:
    kind, score, why = F.lower(result["relationship_type"]), result["confidence_score"], result["reasoning"]
    made = lambda k, s, w: F.struct(k.alias("relationship_type"), s.alias("confidence_score"), w.alias("reasoning"))
    supplies = kind.isin("supplier", "upstream_supplier")
    weak = F.concat(F.lit("Supplier classification downgraded: evidence score "), a["score"].cast("string"), F.lit(f" is below required threshold {LEAST_SCORE}. "), why)
    unsure = F.concat(F.lit(f"Classification downgraded below minimum confidence {LEAST_CONFIDENCE:.2f}. "), why)
    return (
        F.when(supplies & (a["score"] < LEAST_SCORE), made(F.lit("unrelated"), F.least(score, F.lit(0.4)), weak))
        .when((kind != "unrelated") & (score < LEAST_CONFIDENCE), made(F.lit("unrelated"), score, unsure))
        .when(supplies, made(F.when(tier > 1, "upstream_supplier").otherwise("supplier"), score, why))
        .otherwise(made(result["relationship_type"], score, why))
    )


def evidence_quality(evidence: Column) -> Column:
    return F.when(F.coalesce(F.size(evidence), F.lit(0)) > 0, let(analysis(evidence), quality_of)).otherwise(0.0)


def quality_of(a: Column) -> Column:
    """evidence_quality() of evidence that has been analysed."""
    q = F.least(F.lit(1.0), a["score"] / 10) * 0.7 + F.least(F.lit(1.0), a["supporting"] / 2) * 0.3 - F.when(a["negative"] > 0, 0.15).otherwise(0.0)
    return F.round(F.greatest(F.lit(0.0), q), 2)


def source_quality(evidence: Column) -> Column:
    links = F.filter(F.transform(evidence, lambda e: F.lower(e["link"])), lambda x: x.isNotNull() & (x != ""))
    rated = F.transform(links, lambda x: F.when(x.startswith("curated://"), 0.9).when(F.contains(x, F.lit("wikipedia.org")), 0.55).when(x.startswith("http"), 0.7).otherwise(0.4))
    mean = F.aggregate(rated, F.lit(0.0), lambda s, x: s + x) / F.size(links)
    boost = F.least(F.lit(0.1), (F.size(F.array_distinct(F.filter(F.transform(evidence, lambda e: e["link"]), lambda x: x.isNotNull() & (x != "")))) - 1) * 0.05)
    return F.when(F.coalesce(F.size(links), F.lit(0)) > 0, F.round(F.least(F.lit(1.0), mean + boost), 2)).otherwise(0.0)
