"""Suppliers of a run: merging, relationships, quality and coverage metrics, health."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from supplymesh.functions import levels, scoring
from supplymesh.functions.risk import is_external
from supplymesh.operators import relational
from supplymesh.operators.resolve import Identities
from supplymesh.sources import reference_data as R

RETAINED = ("supplier", "upstream_supplier")


def merged(suppliers: DataFrame, identities: Identities) -> DataFrame:
    """Suppliers (seq, name, canonical, location, products, tier, criticality, discovery_confidence, propagated_confidence, parent, path, evidence) with one row for each canonical name.

    Products as a sorted set; evidence as the first item for each link; the greatest confidences and tier; High if any is High, else Medium (of several rows);
    parents and paths as distinct strings in order; the first location that is known. A single row keeps its values. All show the short name."""
    base = suppliers.withColumn("path_text", F.array_join("path", " -> ")).withColumn("high", (F.col("criticality") == "High").cast("int"))
    one = relational.merge_groups(base, "canonical", "seq", unions=["products"], maxima=["tier", "discovery_confidence", "propagated_confidence", "high"], joined={"parent": "; ", "path_text": "|"}, firsts={"location": R.UNKNOWN_LOCATION})
    evidence = relational.first_items_per_field(base, "canonical", "evidence", "link", "seq", "evidence")
    first = base.groupBy("canonical").agg(F.min("seq").alias("seq"), F.min_by("criticality", "seq").alias("criticality"), F.min_by("path", "seq").alias("path"), F.min_by("parent", "seq").alias("own_parent"))
    single = F.col("members") == 1
    return (
        one.join(first, "canonical").join(evidence, "canonical", "left").select(
            "seq", identities.display_name(F.col("canonical")).alias("name"), "canonical", "location", "products", "tier", F.when(single, F.col("criticality")).when(F.col("high") == 1, "High").otherwise("Medium").alias("criticality"),
            "discovery_confidence", "propagated_confidence", F.when(single, F.col("own_parent")).when(F.col("parent") != "", F.col("parent")).alias("parent"), F.when(single, F.col("path")).otherwise(F.split("path_text", r"\|")).alias("path"),
            F.coalesce("evidence", F.array().cast("array<struct<title:string,link:string,snippet:string>>")).alias("evidence"), "members",
        )
    )


def best_relationships(relationships: DataFrame) -> DataFrame:
    """The relationship (canonical, seq, relationship_type, confidence_score) of greatest confidence for each canonical name."""
    return relational.best_per_key(relationships, ["canonical"], "confidence_score", ["seq"])


def retained(suppliers: DataFrame, relationships: DataFrame) -> DataFrame:
    """Suppliers whose best relationship is one of supply; all of them if there are no relationships at all."""
    kept = suppliers.join(best_relationships(relationships).filter(F.col("relationship_type").isin(*RETAINED)).select("canonical"), "canonical", "left_semi")
    none = F.broadcast(relationships.limit(1).agg((F.count("*") == 0).alias("none")))  # one row
    return kept.unionByName(suppliers.join(none).filter("none").drop("none"))


def verification_quality(suppliers: DataFrame, results: DataFrame) -> DataFrame:
    """One row of counts, ratio, factor and label, from suppliers (canonical) and results (canonical, seq, verified), the last of a name counting."""
    last = relational.last_per_key(results.select("canonical", "seq", "verified"), "canonical", "seq")
    ran = F.broadcast(results.limit(1).agg((F.count("*") > 0).alias("ran")))  # one row
    v = F.col("verified")
    counts = suppliers.select("canonical").join(last, "canonical", "left").agg(F.count_if(v).alias("verified_count"), F.count_if(~v).alias("failed_count"), F.count_if(v.isNull()).alias("missing_count"), F.count("*").alias("total_count"))
    ratio = F.coalesce(F.try_divide("verified_count", "total_count"), F.lit(0.0))
    empty, skipped = F.col("total_count") == 0, ~F.col("ran")
    zero = lambda c: F.when(empty | skipped, 0).otherwise(F.col(c)).alias(c)
    factor = F.when(empty | skipped, 1.0).when(F.col("failed_count") + F.col("missing_count") >= 2, ratio).otherwise(F.greatest(F.lit(0.8), ratio))
    return counts.join(ran).select(
        zero("verified_count"), zero("failed_count"), zero("missing_count"), "total_count", F.when(empty, 0.0).when(skipped, 1.0).otherwise(F.round(ratio, 4)).alias("quality_ratio"), F.round(factor, 4).alias("quality_factor"),
        F.when(empty, "Insufficient Data").when(skipped, "Unassessed").otherwise(levels.label_of_ratio(ratio)).alias("label"),
    )


def discovery_coverage(suppliers: DataFrame, expected: DataFrame | None, quality: DataFrame) -> DataFrame:
    """One row of coverage metrics of tier-1 suppliers (canonical, tier) against expected ones (canonical), or against themselves without any; ``quality``: the row of ``verification_quality``."""
    first = suppliers.filter("tier = 1").select("canonical")
    listed = first.agg(F.count("*").alias("listed"), F.count_distinct("canonical").alias("distinct"))
    key = F.lit(1).alias("k")
    wanted = (expected if expected is not None else first).select(key, "canonical")
    m = relational.set_metrics(first.select(key, "canonical"), wanted, "k", "canonical")
    one = listed.join(m, F.lit(True), "left").na.fill(0, ["found", "expected", "matched", "missing", "beyond"]).join(quality.select("quality_factor", F.col("label").alias("quality_label")))
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    coverage, precision, unique = F.least(F.lit(1.0), ratio("matched", "expected")), ratio("matched", "found"), ratio("distinct", "listed")
    raw = [levels.label_of_ratio(x) for x in (coverage, precision, unique)]
    assessed = F.col("quality_label") != "Unassessed"
    label = F.when(assessed, levels.lowest_label(*raw, F.col("quality_label"))).otherwise(levels.lowest_label(*raw))
    adjusted = coverage * precision * unique * F.when(assessed, F.col("quality_factor")).otherwise(1.0)
    return one.select(
        F.lit("expected_suppliers" if expected is not None else "discovered_suppliers").alias("coverage_basis"), F.col("listed").alias("tier1_supplier_count"), F.col("distinct").alias("canonical_tier1_supplier_count"), F.col("expected").alias("expected_count"), F.col("matched").alias("matched_expected_count"),
        F.round(coverage, 4).alias("coverage_ratio"), F.round(precision, 4).alias("precision"), F.round(ratio("beyond", "found"), 4).alias("false_positive_rate"), F.round(unique, 4).alias("canonical_uniqueness_ratio"),
        label.alias("label"), raw[0].alias("raw_coverage_label"), F.round(adjusted, 4).alias("verification_adjusted_ratio"),
    )


def worst_external(risks: DataFrame) -> DataFrame:
    """The worst external risk (canonical, worst) of risks (canonical, risk_type, severity, reasoning)."""
    own = risks.filter(is_external(F.col("risk_type"), F.col("reasoning"))).withColumn("o", levels.ordinal(F.col("severity")))
    return own.groupBy("canonical").agg(F.max_by("severity", "o").alias("worst"))


def scored(suppliers: DataFrame, relationships: DataFrame, verifications: DataFrame, risks: DataFrame, coverage: float = 1.0, cap: float = 1.0) -> DataFrame:
    """Suppliers with relationship_type, verified, worst, final_confidence, criticality_score and criticality_level."""
    rel = best_relationships(relationships).select("canonical", "relationship_type", F.col("confidence_score").alias("rel_score"))
    ver = relational.last_per_key(verifications.select("canonical", "seq", "verified", F.col("confidence_score").alias("ver_score")), "canonical", "seq").select("canonical", "verified", "ver_score")
    products = suppliers.select("canonical", F.explode("products").alias("p")).select("canonical", F.lower("p").alias("p"))
    sole = relational.sole_sources(products, "canonical", "p").select("canonical", (F.col("sole_products") > 0).alias("sole"))
    both = suppliers.join(rel, "canonical", "left").join(ver, "canonical", "left").join(worst_external(risks), "canonical", "left").join(sole, "canonical", "left")
    both = both.withColumn("final_confidence", scoring.confidence(F.col("discovery_confidence"), F.col("rel_score"), F.col("ver_score"), F.col("verified"), F.col("worst"), F.lit(coverage), F.lit(cap)))
    both = both.withColumn("criticality_score", scoring.criticality(F.col("relationship_type"), F.col("products"), F.coalesce("sole", F.lit(False)), F.col("ver_score")))
    return both.withColumn("criticality_level", levels.criticality_level(F.col("criticality_score"))).drop("rel_score", "sole")


def health(scored_suppliers: DataFrame, coverage: float = 1.0, cap: float = 1.0) -> DataFrame:
    """One row of the chain's health."""
    part = scoring.health_part(F.col("final_confidence"), F.col("criticality_score"), F.col("worst"))
    row = scored_suppliers.agg(F.round(F.least(F.avg(part) * 100, F.lit(cap * 100)), 1).alias("overall_score"), F.count("*").alias("supplier_count"), F.count_if(F.col("criticality_level") == "Critical").alias("critical_suppliers"), F.count_if(F.col("worst").isin("High", "Critical")).alias("high_risk_suppliers"))
    return row.withColumn("status", F.when(F.lit(coverage) < 0.5, "Insufficient Data").otherwise(levels.health_status(F.col("overall_score"))))


def key_suppliers(scored_suppliers: DataFrame, most: int = 5) -> DataFrame:
    return scored_suppliers.orderBy(F.desc_nulls_last("criticality_score"), F.desc_nulls_last("final_confidence"), "seq").limit(most)


def top_risks(risks: DataFrame, key: str = "supplier_name", most: int = 3) -> DataFrame:
    """At most so many risks of each supplier, the most severe ones; in their own order where there are no more, else by severity."""
    ranked = risks.withColumn("o", levels.ordinal(F.col("severity")))
    counted = ranked.join(ranked.groupBy(key).agg(F.count("*").alias("n")), key)
    top = relational.topk_per_key(counted, [key], [F.desc("o"), "seq"], most, rank="rank")
    from pyspark.sql import Window as W

    shown = F.row_number().over(W.partitionBy(key).orderBy(F.when(F.col("n") <= most, F.col("seq")).otherwise(F.col("rank"))))
    return top.withColumn("place", shown).drop("o", "n", "rank")


def evaluation(found: DataFrame, expected: DataFrame, company: str = "company", item: str = "canonical", average: bool = False) -> DataFrame:
    """Precision and recall of found against expected names for each company; with ``average`` also a row "Average" of summed counts and mean ratios."""
    m = relational.set_metrics(found, expected, company, item)
    ratio = lambda of: F.round(F.coalesce(F.try_divide("matched", of), F.lit(0.0)), 3)
    rows = m.select(company, F.col("matched").alias("true_positives"), F.col("beyond").alias("false_positives"), F.col("missing").alias("false_negatives"), ratio("found").alias("precision"), ratio("expected").alias("recall"))
    if not average:
        return rows
    counts = [F.sum(c).alias(c) for c in ("true_positives", "false_positives", "false_negatives")]
    return rows.unionByName(rows.agg(F.lit("Average").alias(company), *counts, *(F.round(F.avg(c), 3).alias(c) for c in ("precision", "recall"))))
