"""Scores of suppliers and chains as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from supplymesh.functions.levels import steps
from supplymesh.functions.rounding import py_round
from supplymesh.functions.text import has_any
from supplymesh.sources import reference_data as R

# Words of products by importance; product tags by words.
PRODUCT_HIGH, PRODUCT_MEDIUM, PRODUCT_LOW = ["chip", "semiconductor", "processor", "foundry", "battery", "display", "memory"], ["assembly", "manufacturing", "electronics", "component"], ["packaging", "logistics", "service"]
TAGS = (
    ("Semiconductors", ["chips", "semiconductor", "processor", "soc", "logic"]), ("Logistics Services", ["logistics", "shipping", "supply chain", "warehousing"]),
    ("Display Panels", ["display", "screen", "panel", "oled", "lcd", "led"]), ("Contract Manufacturing", ["assembly", "manufacturing", "outsourced", "factory", "odm", "contract manufacturer"]),
    ("Semiconductor Foundry", ["foundry", "foundries", "wafer", "fabrication"]), ("Semiconductor Packaging/Test", ["osat", "packaging", "assembly and test"]), ("Energy Storage", ["battery", "cells", "power"]),
)
RELATION_WEIGHTS = {"SUPPLIER": 0.25, "PARTNER": 0.2, "ACQUISITION": 0.1, "COMPETITOR": -0.4, "LAWSUIT": -0.3, "CUSTOMER": -0.5, "NEUTRAL": 0.0}


def confidence(discovery: Column, relationship: Column, verification: Column, verified: Column, worst: Column, coverage: Column, cap: Column, exact: bool = False) -> Column:
    """A supplier's confidence: nulls stand for what is missing; ``worst``: its worst external risk."""
    d = F.when(F.coalesce(discovery, F.lit(0.5)) == 0, 0.5).otherwise(F.coalesce(discovery, F.lit(0.5)))
    v = F.when(verification.isNull(), 0.3).when(verified, verification).otherwise(verification * 0.5)
    k = F.when(worst.isNull(), F.when(coverage >= 0.8, 0.75).otherwise(0.55)).when(worst == "Critical", 0.2).when(worst == "High", 0.4).when(worst == "Medium", 0.6).otherwise(0.8)
    return py_round(F.least(d * 0.20 + F.coalesce(relationship, F.lit(0.5)) * 0.30 + v * 0.35 + k * 0.15, cap), 2, exact)


def criticality(relationship_type: Column, products: Column, sole_source: Column, verification: Column, exact: bool = False) -> Column:
    kind, text = F.lower(relationship_type), F.lower(F.array_join(products, " "))
    a = F.when(kind == "supplier", 0.4).when(kind.isin("upstream_supplier", "partner"), 0.3).when(kind == "subsidiary", 0.5).otherwise(0.2)
    b = F.when(has_any(text, PRODUCT_HIGH), 0.3).when(has_any(text, PRODUCT_MEDIUM), 0.2).when(has_any(text, PRODUCT_LOW), 0.1).otherwise(0.05)
    return py_round((a + b + F.when(sole_source, 0.2).otherwise(0.0)) * F.coalesce(verification, F.lit(0.5)), 2, exact)


def risk_share(worst: Column) -> Column:
    """What a supplier's worst risk leaves of the share for risk."""
    return F.when(worst.isNull(), 1.0).when(worst == "Low", 0.8).when(worst == "Medium", 0.6).when(worst == "High", 0.3).when(worst == "Critical", 0.1).otherwise(0.6)


def health_part(confidence_: Column, criticality_: Column, worst: Column) -> Column:
    return 0.30 * F.coalesce(confidence_, F.lit(0.0)) + 0.30 * F.coalesce(criticality_, F.lit(0.0)) + 0.40 * risk_share(worst)


def existence(known: Column, profile_found: Column, profile_industry: Column, profile_website: Column, evidence: Column) -> Column:
    """Confidence that a company exists: known, found in a profile source, or with a website; null if none says so.
    A known company isn't looked up, and counts as found."""
    web = F.exists(evidence, lambda e: F.lower(e["snippet"]).rlike(r"www\.|http"))
    profile = F.when(known, 0.85).when(profile_found, F.when(profile_industry != "Not found", 0.8).otherwise(0.4))
    return F.greatest(F.when(known, 0.92), profile, F.when(F.coalesce(web, F.lit(False)), 0.6).when(~known & profile_found & profile_website.isNotNull(), 0.8))


def verification(exists: Column, known: Column, relationship_type: Column, relationship: Column, evidence_quality: Column, source_quality: Column) -> Column:
    """struct(company_exists, relationship_verified, confidence_score, verified); ``exists``: confidence or null."""
    related = relationship_type.isin("supplier", "upstream_supplier") & (relationship >= 0.65) & (evidence_quality >= 0.5)
    found = F.coalesce(exists, F.when(related & known, 0.86))
    total = F.coalesce(found, F.lit(0.0)) * 0.25 + F.when(related, relationship).otherwise(F.least(relationship, F.lit(0.35))) * 0.35 + evidence_quality * 0.25 + source_quality * 0.15
    total = F.when(found.isNull(), F.least(total, F.lit(0.35))).otherwise(total)
    total = F.least(F.lit(1.0), F.when(related, total).otherwise(F.least(total, F.lit(0.55))))
    return F.struct(found.isNotNull().alias("company_exists"), related.alias("relationship_verified"), total.alias("confidence_score"), (found.isNotNull() & related & (total >= 0.55)).alias("verified"))


def discovery_confidence(count: Column, name: Column, known: Column, relation: Column, analysis: Column, exact: bool = False) -> Column:
    """Confidence in a candidate extracted from search results."""
    plus = lambda yes, x: F.when(yes, x).otherwise(0.0)
    weight = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in RELATION_WEIGHTS.items() for x in kv)), relation), F.lit(0.0))
    total = (
        0.35 + F.least(count * 0.07, F.lit(0.21)) + plus(name.rlike(r"(?i)(Inc|Ltd|Corp|Group|Co|PLC|Corporation|Limited)$"), 0.07) + plus(known, 0.08) + weight
        + plus(analysis["strong"] > 0, 0.12) + plus(analysis["medium"] > 0, 0.08) + plus(analysis["weak"] > 0, 0.03) + plus(analysis["supporting"] > 1, 0.05) - plus(analysis["negative"] > 0, 0.15)
    )
    return py_round(F.greatest(F.lit(0.01), F.least(total, F.lit(0.98))), 2, exact)


def product_tags(snippet: Column, table=TAGS) -> Column:
    """The labels of which a text has a word, in the order of the table."""
    tags = F.array_compact(F.array(*(F.when(has_any(snippet, words), label) for label, words in table)))
    return F.when(F.size(tags) > 0, tags).otherwise(F.array(F.lit("General Components")))


def search_quality(company: Column, snippet: Column) -> Column:
    """5 if the snippet names the company, 2 for each keyword it has."""
    low = F.lower(snippet)
    return F.when(F.contains(low, F.lower(company)), 5).otherwise(0) + 2 * F.size(F.filter(F.array(*map(F.lit, R.SEARCH_KEYWORDS)), lambda k: F.contains(low, k)))


def data_quality(verified: Column, confidence_: Column) -> Column:
    """What is wrong with a supplier's verification: missing, failed, low; null for nothing."""
    return F.when(verified.isNull(), "Missing").when(~verified, "Failed").when(confidence_ < 0.8, "Low confidence")


def industry_fallback(name: Column, industry: Column, table: dict[str, str]) -> Column:
    """The industry, or where it is missing the one given for the name."""
    missing = F.coalesce(industry, F.lit("")).isin("", "Unknown")
    known = F.create_map(*(F.lit(x) for k, v in table.items() for x in (k.lower(), v))) if table else None
    return F.when(missing, F.coalesce(F.try_element_at(known, F.lower(name)), industry) if known is not None else industry).otherwise(industry)
