"""Centroid clustering of vectors by Lloyd's rounds on distinct quantised vectors.

Components become integers, equal integer vectors become one row with its multiplicity, and the rounds run on these rows alone:
each task adds up multiplicity times vector for each centroid in whole numbers, Spark adds up the tasks' sums, and a centroid moves to
the floor of its exact mean. So the result depends neither on the order of rows nor on how they are dealt. In the end the rows get
their vector's assignment by a join.

Vectors are kept that have the asked number of components, none of them null or not finite. With fewer vectors than centroids there are as many centroids as
vectors; no vector at all gives no rows. Of equal distances the smaller number counts. Equal rows are vectors of their own, also among the first centroids.
Rows without an id come after all others there. A distance or sum that doesn't fit the result's type is an error, never a wrong number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from supplymesh.llm.common import lean, prepare, stored

#: Whole numbers below this are exact in doubles.
EXACT = 1 << 53
#: A vector is dealt into so many parts of the join as it has thousandths of all rows.
SHARES = 1000


def finite(vector: Column) -> Column:
    """Whether an array is there and no entry of it is null, infinite or not a number."""
    return F.coalesce(F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))), F.lit(False))


def quantised(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component as a long; beyond a long is an error."""
    scaled = lambda x: x.cast("double") * float(scale)
    return F.transform(vector, lambda x: F.when(F.abs(scaled(x)) < 2.0**62, F.floor(scaled(x))).otherwise(F.raise_error(F.lit("a component is too large to be quantised")).cast("long")))


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and squared distance of each vector's nearest centroid, both exact; of equal ones the smaller number."""
    most = max(int(abs(x).max()) if x.size else 0 for x in (vectors, centroids))
    if 4 * vectors.shape[1] * most * most < EXACT:
        v, c = vectors.astype("f8"), centroids.astype("f8")
        apart = (v * v).sum(1)[:, None] - 2 * (v @ c.T) + (c * c).sum(1)
        at = apart.argmin(1)
        return at, apart[np.arange(len(v)), at].astype("i8")
    c = centroids.astype(object)
    apart = [((row - c) ** 2).sum(1).tolist() for row in vectors.astype(object)]
    at = [min(range(len(row)), key=lambda j: row[j]) for row in apart]
    return np.array(at, "i8"), np.array([row[j] for row, j in zip(apart, at)], "i8")


def _matrix(column: pa.ListArray, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _sums(distinct: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """For each centroid with vectors: how many it has, and the sums of their components. What comes to the driver is one number for each
    centroid and component."""
    k, dims = centroids.shape
    exact = pa.decimal128(38, 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from decimal import Decimal

        total, count = np.zeros((k, dims), object), [0] * k
        for b in batches:
            v, w = _matrix(b.column("q"), dims), b.column("weight").to_numpy(zero_copy_only=False)
            at, _ = nearest(v, centroids)
            most = int(abs(v).max()) * int(w.sum()) if len(v) else 0
            own = (v if most < 1 << 62 else v.astype(object)) * w[:, None]
            for j in np.unique(at).tolist():
                total[j] = total[j] + own[at == j].sum(0).astype(object)
                count[j] += int(w[at == j].sum())
        some = [j for j in range(k) if count[j]]
        sums = pa.array([[Decimal(int(x)) for x in total[j]] for j in some], pa.list_(exact))
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([count[j] for j in some], pa.int64()), sums], names=["cluster", "n", "sums"])

    parts = distinct.select("q", "weight").mapInArrow(lean(run), "cluster int, n long, sums array<decimal(38,0)>")
    each = parts.select("cluster", "n", F.posexplode("sums").alias("at", "x"))
    out: dict[int, tuple[int, list[int]]] = {}
    for r in each.groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum("x").alias("x")).orderBy("cluster", "at").collect():
        out.setdefault(r["cluster"], (r["n"], []))[1].append(int(r["x"]))
    return out


def _assigned(distinct: DataFrame, centroids: np.ndarray) -> DataFrame:
    dims = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, apart = nearest(_matrix(b.column("q"), dims), centroids)
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("weight"), pa.array(at, pa.int32()), pa.array(apart, pa.int64())], names=["key", "weight", "cluster", "distance"])

    return distinct.select("q", "weight", "key").mapInArrow(lean(run), "key binary, weight long, cluster int, distance long")


def cluster(df: DataFrame, k: int = 40, rounds: int = 5, id_column: str = "vec_id", vector: str = "embedding", dims: int = 64, scale: int = 256, seed: str = "2:") -> DataFrame:
    """df's rows with a kept vector, with their cluster, squared distance, cluster_inertia and inertia (decimals) and centroid (array of longs). Columns of these
    names in df are replaced, others kept.

    The first centroids are the k vectors whose seed and id have the least SHA-256. Distinct vectors and their assignments are tables in
    the shared folder; only centroids and their sums pass through the driver."""
    spark = df.sparkSession
    prepare(spark)
    added = ("cluster", "distance", "cluster_inertia", "inertia", "centroid")
    kept = [c for c in df.columns if c not in added]
    v = F.col(f"`{vector}`")
    good = df.filter((F.size(v) == dims) & finite(v))
    rows = good.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("row"), F.col(f"`{id_column}`").alias("id"), quantised(v, scale).alias("q"))
    key = F.unhex(F.sha2(F.array_join(F.col("q"), ","), 256)).alias("key")
    distinct = stored(rows.groupBy("q").agg(F.count("*").alias("weight")).select("q", "weight", key), "distinct-vectors")

    place = F.sha2(F.concat(F.lit(seed), F.col("id").cast("string")).cast("binary"), 256)
    first = rows.select(place.alias("place"), "q").orderBy(F.col("place").asc_nulls_last(), "q").limit(k).collect()
    if not first:
        return good.limit(0).select(*(F.col(f"`{c}`") for c in kept), F.lit(0).alias("cluster"), *(F.lit(0).cast(t).alias(n) for n, t in zip(added[1:4], ("long", "decimal(38,0)", "decimal(38,0)"))), F.array().cast("array<long>").alias("centroid"))
    centroids = np.array([r["q"] for r in first], "i8").reshape(len(first), dims)
    for _ in range(rounds):
        moved = centroids.copy()
        for j, (n, sums) in _sums(distinct, centroids).items():
            moved[j] = [x // n for x in sums]
        centroids = moved

    assigned = stored(_assigned(distinct, centroids), "assigned-vectors")
    weighed = F.col("weight").cast("decimal(19,0)") * F.col("distance").cast("decimal(19,0)")
    inertia = {r["cluster"]: (int(r["x"]), r["n"]) for r in assigned.groupBy("cluster").agg(F.sum(weighed.cast("decimal(38,0)")).alias("x"), F.sum("weight").alias("n")).collect()}
    n, total = sum(x[1] for x in inertia.values()), sum(x[0] for x in inertia.values())
    table = spark.createDataFrame([(j, str(x), str(total), centroids[j].tolist()) for j, (x, _) in inertia.items()], "cluster int, a string, b string, centroid array<long>")
    told = table.select("cluster", F.col("a").cast("decimal(38,0)").alias("cluster_inertia"), F.col("b").cast("decimal(38,0)").alias("inertia"), "centroid")

    # a vector with many rows is dealt into parts of at most a thousandth of all rows; there can't be a thousand such vectors
    parts = F.ceil(F.col("weight") * SHARES / n).cast("int")
    hot = F.broadcast(assigned.filter(F.col("weight") * SHARES > n).select("key", parts.alias("parts")))
    many = assigned.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("weight")
    dealt = rows.select("row", key).join(hot, "key", "left").withColumn("part", F.floor(F.rand(1) * F.coalesce("parts", F.lit(1))).cast("int"))
    found = dealt.drop("parts").join(many, ["key", "part"]).join(F.broadcast(told), "cluster")  # told: a row for each centroid
    return found.select("row.*", *added)
