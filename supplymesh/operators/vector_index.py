"""An inverted file of vectors: a table by cells, written once and searched exactly without looking at every cell.

Centres are fitted on a bounded sample; every vector that has a direction goes to the cell of its nearest centre, with its distance to it, as a
row of a Parquet table partitioned by cell. Distances are those of unit vectors, so that near ones have a high cosine. By the triangle
inequality a vector is at least |d(query, centre) - d(vector, centre)| away from a query. A query first visits the nearest cells that hold
enough vectors; the distance of its k-th hit there then rules out whole cells and, in the others, all vectors whose distance to the centre is
too different. What is left is compared, so the result is that of comparing all pairs: recall is 1 by the bound.
How much is ruled out depends on the vectors: tight clusters leave few cells, vectors without any structure leave most of them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from supplymesh.operators.vector import cosine
from supplymesh.sources.scratch import settled

#: Vectors that the centres are fitted on at most, cells at most, rounds of fitting.
SAMPLE, CELLS, FIT_ROUNDS = 20_000, 4096, 5
#: Bytes of the queries that are searched at a time.
BLOCK_BYTES = 16 << 20
#: What rounding may change in a similarity or distance.
SLACK = 1e-6


def with_direction(df: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector is finite and not all zeros."""
    v = F.col(vector)
    return df.filter(F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))) & F.exists(v, lambda x: x != 0))


def _units(column: pa.ListArray) -> np.ndarray:
    m = column.flatten().to_numpy(zero_copy_only=False).astype("f8").reshape(len(column), -1)
    m = m / np.abs(m).max(1, keepdims=True)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def _apart(units: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 1.0 - 2.0 * (units @ centres.T) + (centres * centres).sum(1)))


@dataclass(frozen=True)
class VectorIndex:
    """Rows (id, vector, distance, cell) and, for each cell: its centre, how many rows it has, and their least and greatest distance."""

    rows: DataFrame
    centres: np.ndarray
    sizes: np.ndarray
    low: np.ndarray
    high: np.ndarray


def write_index(vectors: DataFrame, path: str, id_column: str = "vec_id", vector: str = "embedding", cells: int | None = None) -> VectorIndex:
    """Writes an index of all vectors that have an id and a direction, all of one length, and opens it. By default about as many cells as the root of the number
    of rows, CELLS at most. Rows are dealt to files by ranges of cell and distance, so that a large cell is several tasks'."""
    spark = vectors.sparkSession
    known = with_direction(vectors.select(F.col(id_column).alias("id"), F.col(vector).alias("vector")).filter(F.col("id").isNotNull()), "vector")
    n = known.count()
    cells = max(1, min(CELLS, math.isqrt(n) if cells is None else cells))
    share = F.pmod(F.xxhash64("id", F.lit(11)), F.lit(1 << 30)) < min(1.0, SAMPLE / max(1, n)) * (1 << 30)

    @F.pandas_udf("array<double>")
    def unit(x: pd.Series) -> pd.Series:
        return pd.Series(list(_units(pa.array(x.to_list(), pa.list_(pa.float64())))) if len(x) else [], dtype=object)

    sample = known.filter(share).select(array_to_vector(unit("vector")).alias("features"))
    if sample.isEmpty():
        sample = known.limit(SAMPLE).select(array_to_vector(unit("vector")).alias("features"))
    if n:
        model = KMeans(k=cells, maxIter=FIT_ROUNDS, initMode="random", seed=7).fit(sample) if cells > 1 else None
        centres = np.array(model.clusterCenters()) if model else np.zeros((1, len(known.first()["vector"])))
    else:
        centres = np.zeros((0, 0))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                apart = _apart(_units(b.column(1)), centres)
                cell = apart.argmin(1)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(apart[np.arange(len(cell)), cell]), pa.array(cell, pa.int32())], names=["id", "vector", "distance", "cell"])

    kinds = dict(known.dtypes)
    placed = known.mapInArrow(dealt, f"id {kinds['id']}, vector {kinds['vector']}, distance double, cell int")
    placed.repartitionByRange("cell", "distance").sortWithinPartitions("cell", "distance").write.partitionBy("cell").parquet(f"{path}/rows")
    placed.limit(0).write.parquet(f"{path}/shape")  # an index without rows has no files to tell its columns
    rows = spark.read.schema(placed.schema).parquet(f"{path}/rows")
    found = {r["cell"]: r for r in rows.groupBy("cell").agg(F.count("*").alias("n"), F.min("distance").alias("low"), F.max("distance").alias("high")).collect()}
    table = [(j, centres[j].tolist(), r["n"], r["low"], r["high"]) for j, r in sorted(found.items())]
    spark.createDataFrame(table, "cell int, centre array<double>, n long, low double, high double").coalesce(1).write.parquet(f"{path}/cells")
    return open_index(spark, path)


def open_index(spark: SparkSession, path: str) -> VectorIndex:
    """An index that was written; its cells, CELLS at most, come to the driver."""
    cells = spark.read.parquet(f"{path}/cells").orderBy("cell").collect()
    most = 1 + max((r["cell"] for r in cells), default=-1)
    centres, sizes, low, high = np.zeros((most, len(cells[0]["centre"]) if cells else 0)), np.zeros(most, "i8"), np.zeros(most), np.zeros(most)
    for r in cells:
        centres[r["cell"]], sizes[r["cell"]], low[r["cell"]], high[r["cell"]] = r["centre"], r["n"], r["low"], r["high"]
    return VectorIndex(spark.read.schema(spark.read.parquet(f"{path}/shape").schema).parquet(f"{path}/rows"), centres, sizes, low, high)


def search(index: VectorIndex, queries: DataFrame, k: int, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """For each query with a direction the k most similar other rows of the index: query_id, id, rank, similarity; of equally similar ones those with smaller ids. Rows
    with the query's own id are no hits. Queries are broadcast in blocks of BLOCK_BYTES, one searched after the other."""
    asked = with_direction(queries.select(F.col(id_column).alias("query_id"), F.col(vector).alias("asked")).filter(F.col("query_id").isNotNull()), "asked")
    dims = index.centres.shape[1]
    n = asked.count()
    blocks = max(1, -(-n * dims * 8 // BLOCK_BYTES))
    if not n or not len(index.centres):
        kind = dict(asked.dtypes)["query_id"]
        return queries.sparkSession.createDataFrame([], f"query_id {kind}, id {dict(index.rows.dtypes)['id']}, rank int, similarity double")
    dealt = settled(asked.withColumn("block", F.pmod(F.monotonically_increasing_id(), F.lit(blocks))))
    found = None
    for b in range(blocks):
        one = _search_block(index, dealt.filter(F.col("block") == b).select("query_id", "asked"), k)
        found = one if found is None else found.unionByName(one)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("similarity"), "id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "id", "rank", "similarity")


def visits(low: np.ndarray, high: np.ndarray, apart: np.ndarray, reach: np.ndarray) -> np.ndarray:
    """Which cells (columns) may hold a vector within reach of each query (rows), by their least and greatest distances and the queries' distances to their centres."""
    return np.maximum(apart - high, low - apart) <= reach[:, None] + SLACK


def _enough(index: VectorIndex, units: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each query the distance of the last of the nearest centres whose cells hold more than k rows together; the cells that any query needs."""
    inner, needed = np.empty(len(units)), np.zeros(len(index.sizes), "?")
    for i in range(0, len(units), 1000):  # distances of a thousand queries at a time
        apart = np.where(index.sizes > 0, _apart(units[i : i + 1000], index.centres), np.inf)
        order = np.argsort(apart, axis=1)
        last = np.minimum((np.cumsum(index.sizes[order], axis=1) <= k).sum(1), (index.sizes > 0).sum() - 1)
        inner[i : i + 1000] = apart[np.arange(len(apart)), order[np.arange(len(apart)), last]]
        needed |= (apart <= inner[i : i + 1000, None]).any(0)
    return inner, needed


def _within(index: VectorIndex, units: np.ndarray, reach: np.ndarray) -> np.ndarray:
    """The cells that some query has to visit."""
    needed = np.zeros(len(index.sizes), "?")
    for i in range(0, len(units), 1000):
        needed |= visits(index.low, index.high, _apart(units[i : i + 1000], index.centres), reach[i : i + 1000]).any(0)
    return needed & (index.sizes > 0)


def _search_block(index: VectorIndex, block: DataFrame, k: int) -> DataFrame:
    rows = block.collect()
    ids = [r["query_id"] for r in rows]
    units = _units(pa.array([r["asked"] for r in rows], pa.list_(pa.float64())))
    inner, needed = _enough(index, units, k)
    near = _visited(index, needed, ids, units, inner, None, k)
    w = W.partitionBy("at").orderBy(F.desc("s"), "id")
    reach = np.full(len(ids), np.inf)
    for r in near.withColumn("n", F.row_number().over(w)).filter(F.col("n") == k).select("at", "s").collect():
        reach[r["at"]] = math.sqrt(max(0.0, 2.0 - 2.0 * r["s"])) + SLACK
    found = _visited(index, _within(index, units, reach), ids, units, inner, reach, k)
    spark = block.sparkSession
    table = F.broadcast(spark.createDataFrame([(i, r["query_id"], r["asked"]) for i, r in enumerate(rows)], f"at int, query_id {dict(block.dtypes)['query_id']}, asked {dict(block.dtypes)['asked']}"))  # BLOCK_BYTES at most
    return found.join(table, "at").select("query_id", "id", cosine(F.col("asked"), F.col("vector")).alias("similarity"))


def _visited(index: VectorIndex, needed: np.ndarray, ids: list, units: np.ndarray, inner: np.ndarray, reach: np.ndarray | None, k: int) -> DataFrame:
    """(at, id, vector, s): of the rows in needed cells those that are among a task's k best of a query, or as good. Without reach each query visits the cells
    whose centres are at most ``inner`` away, with it those that may have a row within reach, the nearest again."""
    spark = index.rows.sparkSession
    cells = np.flatnonzero(needed).tolist()
    shared = spark.sparkContext.broadcast((np.array(ids, object), units, inner, np.full(len(ids), np.inf) if reach is None else reach, index.centres, index.low, index.high))
    again = reach is not None
    kinds = dict(index.rows.dtypes)
    named = pa.schema([("at", pa.int32())])

    def best(found: pd.DataFrame) -> pd.DataFrame:
        """Without rows that can't be among a query's first k; of equal vectors only those with the k smallest ids count."""
        found = found.sort_values(["at", "s", "id"], ascending=[True, False, True], kind="stable")
        cut = found.groupby("at")["s"].transform(lambda s: s.iloc[min(k, len(s)) - 1])
        full = found.groupby("at")["s"].transform("size") >= k
        found = found[(found["s"] >= cut - SLACK) | ~full]
        return found[found.sort_values("id", kind="stable").groupby(["at", "key"]).cumcount().reindex(found.index) < k]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, q, inner, limit, centres, low, high = shared.value
        kept, vectors, size, kind = None, {}, 0, None
        for b in batches:
            if not b.num_rows:
                continue
            kind = b.schema
            own_ids, distance, cell = np.array(b.column(0).to_pylist(), object), b.column(2).to_numpy(), b.column(3).to_numpy()
            u, raw = _units(b.column(1)), b.column(1).to_pylist()
            parts = []
            for c in np.unique(cell).tolist():
                far = _apart(q, centres[c : c + 1])
                own = visits(low[c : c + 1], high[c : c + 1], far, limit) if again else far <= inner[:, None] + SLACK
                at, r = np.flatnonzero(own[:, 0]), np.flatnonzero(cell == c)
                if not len(at):
                    continue
                band = np.abs(far[at, 0][None, :] - distance[r][:, None]) <= limit[at][None, :] + SLACK
                s = u[r] @ q[at].T
                near = band & (s >= 1.0 - np.minimum(limit[at], 2.0)[None, :] ** 2 / 2 - SLACK) & (own_ids[r][:, None] != names[at][None, :])
                x, y = np.nonzero(near)
                parts.append(pd.DataFrame({"at": at[y], "s": s[x, y], "row": r[x]}))
            if not parts or not sum(map(len, parts)):
                continue
            new = pd.concat(parts)
            new["id"] = own_ids[new["row"]]
            keys = {i: b.column(1)[i].values.to_numpy(zero_copy_only=False).tobytes() for i in np.unique(new["row"]).tolist()}
            new["key"] = [keys[i] for i in new["row"]]
            vectors.update((keys[i], raw[i]) for i in keys)
            kept = best(pd.concat([kept, new.drop(columns="row")], ignore_index=True))
            vectors = {x: vectors[x] for x in kept["key"].unique()}
            # what is kept so far bounds what may still come
            worst = kept.groupby("at")["s"].agg(["size", "min"])
            worst = worst[worst["size"] >= k]
            limit = limit.copy()
            limit[worst.index] = np.minimum(limit[worst.index], np.sqrt(np.maximum(0.0, 2.0 - 2.0 * worst["min"])) + SLACK)
        if kept is not None:
            yield pa.RecordBatch.from_arrays([pa.array(kept["at"], pa.int32()), pa.array(kept["id"].tolist(), kind.field(0).type), pa.array([vectors[x] for x in kept["key"]], kind.field(1).type), pa.array(kept["s"], pa.float64())], names=[*named.names, "id", "vector", "s"])

    visited = index.rows.filter(F.col("cell").isin(cells)).select("id", "vector", "distance", "cell")
    return visited.mapInArrow(run, f"at int, id {kinds['id']}, vector {kinds['vector']}, s double")
