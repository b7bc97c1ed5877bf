"""Tier expansion over an edge table: breadth-first with a global visited set, and all paths to a depth."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from supplymesh.operators.relational import numbered_overall, topk_per_key
from supplymesh.sources.scratch import settled


@dataclass(frozen=True)
class Limits:
    """Bounds of an expansion; None is none."""

    max_depth: int = 2
    per_parent: int | None = 5
    queue: int | None = 50
    total: int | None = 50


#: Tiers from this one on have the same gate.
GATED = 4
#: The result of an expansion: ``seq`` is the order in which rows come out.
EXPANDED = "seq long, name string, tier int, parent string, path array<string>, confidence double, propagated double"


def expand_tiers(edges: DataFrame, root: str, limits: Limits = Limits(), mode: str = "exact") -> DataFrame:
    """Rows reached from root over edges (source, name, confidence, seq), EXPANDED.

    A parent's candidates are taken by falling confidence, then ``seq``; each name comes out once, under the first parent that
    takes it. Rows of tier up to max_depth come out (tier 1 always); a row is a parent in turn if its tier is less than that.
    Confidence is handed on as the product along the path, rounded to two digits. Edges with a column gate_tier are taken only in that tier; of
    tiers beyond GATED, in the last one's.

    ``exact``: as if parents chose one after the other; what earlier ones took is left out *before* a parent's first ``per_parent`` are
    chosen. See accepted_offers: all of a level choose at once, in Spark; the driver gets counts. A level's first ``queue`` rows are parents, ``total`` in all. ``parallel``: a level at once, without limits on parents; candidates are cut to
    ``per_parent`` first, and names taken twice are then given to the earlier parent: other rows where siblings share names.
    """
    spark = edges.sparkSession
    known = edges.select("source", "name", F.col("confidence").cast("double").alias("confidence"), "seq", *[c for c in edges.columns if c == "gate_tier"]).filter(F.col("name").isNotNull())
    if mode == "parallel":
        return _expand_parallel(spark, known, root, limits)
    if mode != "exact":
        raise ValueError("mode is exact or parallel")
    parents = spark.createDataFrame([(0, root, [root], None)], "at long, source string, over array<string>, handed double")
    visited, levels, popped, numbered = parents.select(F.col("source").alias("name")), [], 0, 0
    for depth in range(max(1, limits.max_depth)):
        asking = parents.count()
        if limits.total is not None:
            asking = max(0, min(asking, limits.total - popped))
            parents = parents.filter(F.col("at") < asking)
        popped += asking
        if not asking:
            break
        offers = _in_tier(known, depth + 1).join(parents.select("at", "source"), "source").join(visited, "name", "left_anti").select("at", "name", "confidence", "seq")
        taken = accepted_offers(settled(offers), limits.per_parent)
        ordered = numbered_overall(taken, ["at", F.desc_nulls_last("confidence"), "seq", "name"], "place")
        level = settled(ordered.join(parents, "at").select(
            (F.col("place") + numbered).alias("seq"), "name", F.lit(depth + 1).alias("tier"), F.col("source").alias("parent"), F.concat("over", F.array("name")).alias("path"), "confidence",
            F.when(F.col("handed").isNull(), F.col("confidence")).otherwise(F.round(F.col("handed") * F.col("confidence") + 1e-9, 2)).alias("propagated"),
        ))
        levels.append(level)
        visited = visited.unionByName(level.select("name"))
        parents = level.select((F.col("seq") - numbered).alias("at"), F.col("name").alias("source"), F.col("path").alias("over"), F.col("propagated").alias("handed"))
        if limits.queue is not None:
            parents = parents.filter(F.col("at") < limits.queue)
        numbered += level.count()
    out = spark.createDataFrame([], EXPANDED)
    for level in levels:
        out = out.unionByName(level)
    return out


def accepted_offers(offers: DataFrame, per_parent: int | None) -> DataFrame:
    """What parents take that choose one after the other, by rising ``at``, each its first ``per_parent`` names by falling confidence, then seq, of those that no earlier one
    took: rows (at, name, confidence, seq).

    All parents choose at once, and again until nothing changes: each asks for its first names, a name accepts the earliest parent that asks for it, and is
    struck off the lists of all later ones (deferred acceptance; as all names rank the parents alike, there is one stable end, that of taking turns). A name's holder only ever
    becomes earlier, so what is struck off stays so. Each round is an aggregation by name and a limit by parent, which Spark applies before its shuffle, so that a parent with very many names is
    split; there are as many rounds as refusals follow from each other, one if no names are shared."""
    order = F.struct(F.col("confidence").isNull(), -F.col("confidence"), F.col("seq"))
    left = offers.groupBy("at", "name").agg(F.min_by(F.struct("confidence", "seq"), order).alias("best")).select("at", "name", "best.confidence", "best.seq")
    if per_parent is None:
        return left.groupBy("name").agg(F.min_by(F.struct("at", "confidence", "seq"), "at").alias("x")).select("x.at", "name", "x.confidence", "x.seq")
    while True:
        asked = topk_per_key(left, ["at"], [F.desc("confidence"), "seq", "name"], per_parent)
        held = settled(asked.groupBy("name").agg(F.min("at").alias("holder"), F.count("*").alias("asking")))
        if not held.filter("asking > 1").limit(1).count():
            return asked
        kept = left.join(held.select("name", "holder"), "name", "left").filter(F.col("holder").isNull() | (F.col("at") <= F.col("holder")))
        left = settled(kept.drop("holder").select("at", "name", "confidence", "seq"))


def _in_tier(edges: DataFrame, tier: int) -> DataFrame:
    return edges.filter(F.col("gate_tier") == min(tier, GATED)).drop("gate_tier") if "gate_tier" in edges.columns else edges


def _expand_parallel(spark: SparkSession, known: DataFrame, root: str, limits: Limits) -> DataFrame:
    key = T.StructType([T.StructField("parent_seq", T.ArrayType(T.LongType())), *(T.StructField(n, k) for n, k in (("name", T.StringType()), ("tier", T.IntegerType()), ("parent", T.StringType()), ("path", T.ArrayType(T.StringType())), ("confidence", T.DoubleType()), ("propagated", T.DoubleType())))])
    frontier = spark.createDataFrame([([], root, 0, None, [root], None, None)], key)
    visited, levels = frontier.select("name"), []
    for depth in range(max(1, limits.max_depth)):
        found = frontier.select(F.col("name").alias("source"), F.col("parent_seq").alias("above"), F.col("path").alias("over"), F.col("propagated").alias("handed")).join(_in_tier(known, depth + 1), "source").join(visited, "name", "left_anti")
        ranked = found.withColumn("n", F.row_number().over(W.partitionBy("source").orderBy(F.desc("confidence"), "seq")))
        if limits.per_parent is not None:
            ranked = ranked.filter(F.col("n") <= limits.per_parent)
        first = ranked.withColumn("t", F.row_number().over(W.partitionBy("name").orderBy("above", "n"))).filter("t = 1")
        frontier = first.select(
            F.concat("above", F.array(F.col("n").cast("long"))).alias("parent_seq"), "name", F.lit(depth + 1).alias("tier"), F.col("source").alias("parent"), F.concat("over", F.array("name")).alias("path"), "confidence",
            F.when(F.col("handed").isNull(), F.col("confidence")).otherwise(F.round(F.col("handed") * F.col("confidence") + 1e-9, 2)).alias("propagated"),
        )
        frontier = settled(frontier)
        levels.append(frontier)
        visited = visited.unionByName(frontier.select("name"))
    every = levels[0]
    for level in levels[1:]:
        every = every.unionByName(level)
    return numbered_overall(every, ["tier", "parent_seq"], "seq").select("seq", "name", "tier", "parent", "path", "confidence", "propagated")


def all_paths(edges: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    """Every path from the roots (name) over edges (source, name) with no name twice: name, tier, path. One join for each level."""
    level = roots.select("name", F.lit(0).alias("tier"), F.array("name").alias("path"))
    out = None
    for d in range(1, depth + 1):
        level = level.select(F.col("name").alias("source"), F.col("path").alias("over")).join(edges.select("source", "name"), "source").filter(~F.array_contains("over", F.col("name"))).select("name", F.lit(d).alias("tier"), F.concat("over", F.array("name")).alias("path"))
        out = level if out is None else out.unionByName(level)
    return out


def star_graph(suppliers: DataFrame, root: str, relationship: str = "relationship") -> tuple[DataFrame, DataFrame]:
    """Nodes (id, label, node_type) and edges (source, target, relationship) of a graph with the root in the middle."""
    spark = suppliers.sparkSession
    nodes = spark.createDataFrame([(root, root, "company")], "id string, label string, node_type string").unionByName(suppliers.select(F.col("name").alias("id"), F.col("name").alias("label"), F.lit("supplier").alias("node_type")))
    kind = F.coalesce(relationship, F.lit("supplier")) if relationship in suppliers.columns else F.lit("supplier")
    return nodes, suppliers.select(F.lit(root).alias("source"), F.col("name").alias("target"), kind.alias("relationship"))


def tier_edges(expanded: DataFrame) -> DataFrame:
    """The edges from parent to child of an expansion."""
    return expanded.select(F.col("parent").alias("source"), F.col("name").alias("target"), "tier", "propagated")
