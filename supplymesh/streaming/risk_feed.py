"""A stream of news items to risks. An extension: the library's other operators work on tables at rest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from supplymesh.functions import risk


def news_risks(items: DataFrame, late: str = "1 day") -> DataFrame:
    """Risks of a stream (supplier_name, canonical, aliases, title, snippet, published timestamp): each title of a supplier counts once within ``late``."""
    once = items.withWatermark("published", late).dropDuplicatesWithinWatermark(["supplier_name", "title"])
    name, terms = F.col("supplier_name"), F.concat(F.array("supplier_name", "canonical"), "aliases")
    rated = once.withColumn("relevance", risk.relevance(name, F.col("canonical"), F.col("aliases"), F.col("title"), F.col("snippet"))).filter(F.col("relevance") >= risk.LEAST_RELEVANCE)
    found = rated.withColumn("risk", risk.news_risk(name, terms, F.col("title"), F.col("snippet"))).filter(F.col("risk.severity").isNotNull())
    return found.select("supplier_name", "published", "title", "risk.severity", "risk.confidence", "risk.reasoning")


def severity_counts(risks: DataFrame, window: str = "1 day", late: str = "1 day") -> DataFrame:
    """Risks by supplier, severity and tumbling window."""
    return risks.withWatermark("published", late).groupBy(F.window("published", window), "supplier_name", "severity").agg(F.count("*").alias("n"))
