"""Exact similarity search over vectors in a table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from supplymesh.sources.scratch import settled

#: Queries that are broadcast at a time, about.
BLOCK_QUERIES = 10_000


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null for a vector of zeros."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def top_similar(queries: DataFrame, vectors: DataFrame, k: int, id_column: str = "vec_id", vector: str = "embedding", most_queries: int | None = None) -> DataFrame:
    """For each query the k most similar other vectors: query_id, id, rank, similarity. Every vector is compared with every query.

    About BLOCK_QUERIES queries are broadcast at a time; each partition of vectors then keeps its best before a shuffle. More queries are
    dealt into blocks, one searched after the other. With ``most_queries`` a caller can refuse larger searches."""
    n = queries.count()
    if most_queries is not None and n > most_queries:
        raise ValueError(f"more than {most_queries} queries")
    q = queries.select(F.col(id_column).alias("query_id"), F.col(vector).alias("__q"))
    v = vectors.select(F.col(id_column).alias("id"), F.col(vector).alias("__v"))
    blocks = -(-n // BLOCK_QUERIES)
    if blocks <= 1:
        return _best(_scored(q, v), k)
    # rows are dealt in turn, so that a block holds its share and one row of each partition at most
    dealt = settled(q.withColumn("__block", F.pmod(F.monotonically_increasing_id(), F.lit(blocks))))
    found = [settled(_best(_scored(dealt.filter(F.col("__block") == b).drop("__block"), v), k)) for b in range(blocks)]
    # a query_id that is repeated may be in several blocks
    return _best(reduce(DataFrame.unionByName, found), k)


def _scored(q: DataFrame, v: DataFrame) -> DataFrame:
    both = v.join(F.broadcast(q), F.col("id") != F.col("query_id"))
    return both.select("query_id", "id", cosine(F.col("__q"), F.col("__v")).alias("similarity"))


def _best(scored: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("similarity"), "id"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "id", "rank", "similarity")
