"""Centroid clustering against plain Lloyd rounds in Python's whole numbers."""

import hashlib
import math
import random

import numpy as np

from supplymesh.llm import centroids
from supplymesh.llm.queries import op13_centroids

SHAPE = "vec_id long, embedding array<float>, cluster string, extra string"


def plain(rows, k, rounds, dims, scale):
    """(row's place, cluster, distance, cluster inertia, inertia, centroid) of kept rows."""
    kept = [(i, r[0], [math.floor(scale * float(x)) for x in r[1]]) for i, r in enumerate(rows) if r[1] is not None and len(r[1]) == dims and all(x is not None and math.isfinite(x) for x in r[1])]
    place = lambda r: (r[1] is None, hashlib.sha256(f"2:{r[1]}".encode()).hexdigest() if r[1] is not None else "", r[2])
    middle = [r[2] for r in sorted(kept, key=place)[:k]]

    def near(q):
        apart = [sum((a - b) ** 2 for a, b in zip(q, c)) for c in middle]
        return apart.index(min(apart)), min(apart)

    for _ in range(rounds):
        groups = {}
        for _, _, q in kept:
            groups.setdefault(near(q)[0], []).append(q)
        middle = [[sum(x) // len(groups[j]) for x in zip(*groups[j])] if j in groups else c for j, c in enumerate(middle)]
    found = [(i, *near(q)) for i, _, q in kept]
    total = sum(x for _, _, x in found)
    return sorted((i, c, x, sum(y for _, d, y in found if d == c), total, middle[c]) for i, c, x in found)


def test_against_plain_rounds(spark):
    r = random.Random(5)
    f = lambda x: float(np.float32(x))
    vectors = [[f(r.uniform(-1, 1)) for _ in range(4)] for _ in range(60)]
    rows = [(i, r.choice(vectors), "clash", str(i)) for i in range(150)]
    rows += [(1000 + i, vectors[0], "clash", f"hot{i}") for i in range(90)]
    rows += [(7, vectors[3], None, "repeat"), (7, vectors[3], None, "repeat2"), (None, vectors[4], None, "noid"), (None, vectors[5], None, "noid2"), (9, None, None, "none"), (10, [], None, "empty"), (11, [1.0, None, 0.0, 0.0], None, "null"), (12, [1.0, math.nan, 0.0, 0.0], None, "nan"), (13, [1.0, math.inf, 0.0, 0.0], None, "inf"), (14, [1.0] * 5, None, "long")]
    df = spark.createDataFrame(rows, SHAPE).repartition(5)
    for k, rounds in ((7, 3), (1, 1), (400, 2)):
        got = centroids.cluster(df, k=k, rounds=rounds, dims=4).collect()
        at = {x[3]: i for i, x in enumerate(rows)}
        assert sorted((at[g["extra"]], g["cluster"], g["distance"], int(g["cluster_inertia"]), int(g["inertia"]), g["centroid"]) for g in got) == plain(rows, k, rounds, 4, 256)
    assert got[0].asDict().keys() == {"vec_id", "embedding", "extra", "cluster", "distance", "cluster_inertia", "inertia", "centroid"}


def test_ties_and_empty_tables(spark):
    rows = [(i, [float(x), 0.0], None, "") for i, x in enumerate((0, 1, 2, 2, 2, 1))]
    got = centroids.cluster(spark.createDataFrame(rows, SHAPE), k=3, rounds=0, dims=2)
    assert {(g["vec_id"], g["cluster"], g["distance"]) for g in got.collect()} == {(i, c, d) for i, c, d, *_ in plain(rows, 3, 0, 2, 256)}
    none = centroids.cluster(spark.createDataFrame([(1, None, None, "")], SHAPE), dims=2)
    assert none.collect() == [] and none.dtypes == got.dtypes


def test_nearest_is_exact_beyond_doubles():
    v, c = np.array([[2**31 + 1, 5]], "i8"), np.array([[2**31, 5], [2**31 + 1, 6], [0, 0]], "i8")
    assert [x.tolist() for x in centroids.nearest(v, c)] == [[0], [1]]
    r = np.random.default_rng(3)
    v, c = r.integers(-300, 300, (50, 6)), r.integers(-300, 300, (9, 6))
    at, apart = centroids.nearest(v, c)
    whole = ((v[:, None] - c[None]) ** 2).sum(2)
    assert at.tolist() == whole.argmin(1).tolist() and apart.tolist() == whole.min(1).tolist()


def test_query_has_a_row_for_each_vector(spark):
    sf = "/root/testdata/sf0.001"
    assert op13_centroids(spark, sf).count() == spark.read.parquet(f"{sf}/embeddings.parquet").count()
