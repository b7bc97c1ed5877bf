"""Ordered labels and step functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Severities with their order; labels with theirs; steps of (least value, result).
SEVERITY = {"Critical": 4, "High": 3, "Medium": 2, "Low": 1}
LABELS = {"Insufficient Data": 0, "Low": 1, "Medium": 2, "High": 3, "Unassessed": 3}
CAPS = ((0.8, 1.0), (0.5, 0.78), (0.3, 0.6))
HEALTH = ((90, "Excellent"), (75, "Good"), (60, "Moderate"), (40, "Weak"))
CRITICALITY = ((0.85, "Critical"), (0.7, "High"), (0.5, "Medium"))
RISK_LEVEL = ((85, "Low"), (70, "Moderate"), (50, "Elevated"))


def steps(value: Column, table, otherwise) -> Column:
    """The result of the first step that the value reaches."""
    (least, result), *rest = table
    out = F.when(value >= least, F.lit(result))
    for least, result in rest:
        out = out.when(value >= least, F.lit(result))
    return out.otherwise(otherwise if isinstance(otherwise, Column) else F.lit(otherwise))


def ordinal(label: Column, table: dict[str, int] = SEVERITY) -> Column:
    """A label's place in its order; 0 if it has none."""
    out = None
    for name, place in table.items():
        out = F.when(label == name, place) if out is None else out.when(label == name, place)
    return out.otherwise(0)


def label_of_ratio(ratio: Column) -> Column:
    return F.when(ratio >= 0.8, "High").when(ratio >= 0.5, "Medium").when(ratio > 0, "Low").otherwise("Insufficient Data")


def lowest_label(*labels: Column) -> Column:
    """The first of the labels that are lowest."""
    placed = F.array(*(F.struct(ordinal(x, LABELS).alias("o"), F.lit(i).alias("i"), x.alias("x")) for i, x in enumerate(labels)))
    return F.array_min(placed)["x"]


def coverage_cap(ratio: Column) -> Column:
    return steps(ratio, CAPS, F.when(ratio > 0, 0.45).otherwise(0.25))


def health_status(score: Column) -> Column:
    return steps(score, HEALTH, "Critical")


def criticality_level(score: Column) -> Column:
    return steps(score, CRITICALITY, "Low")


def risk_level(score: Column) -> Column:
    return F.when(score.isNull(), "Unknown").otherwise(steps(score, RISK_LEVEL, "High"))
