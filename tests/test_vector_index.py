"""The vector index against all pairs."""

import random

import numpy as np
import pytest

from supplymesh.operators import vector, vector_index


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def clustered(r, groups, each, dims=8, width=0.05):
    middles = [[r.gauss(0, 1) for _ in range(dims)] for _ in range(groups)]
    return [[x + r.gauss(0, width) for x in m] for m in middles for _ in range(each)]


@pytest.mark.parametrize("cells", [1, 7])
def test_same_rows_as_all_pairs(spark, tmp_path, cells):
    r = random.Random(cells)
    rows = [(i, v) for i, v in enumerate(clustered(r, 12, 20))]
    rows += [(1000 + i, rows[5][1]) for i in range(60)]  # many ties
    rows += [(2000, [2 * x for x in rows[7][1]]), (3, rows[4][1]), (None, rows[1][1]), (5000, None), (5001, [0.0] * 8), (5002, [float("nan")] * 8), (5003, [1.0] * 7 + [float("inf")])]
    v = table(spark, rows).repartition(6)
    good = vector_index.with_direction(v, "embedding").filter("vec_id is not null")
    index = vector_index.write_index(v, str(tmp_path / "index"), cells=cells)
    assert index.rows.count() == good.count() == int(index.sizes.sum())
    again = vector_index.open_index(spark, str(tmp_path / "index"))
    for k, asked in ((1, "vec_id % 9 = 0"), (4, "vec_id % 31 = 0 or vec_id = 5"), (400, "vec_id = 8")):
        got = sorted(tuple(x)[:3] for x in vector_index.search(again, v.filter(asked), k).collect())
        assert got == sorted(tuple(x)[:3] for x in vector.top_similar(good.filter(asked), good, k).collect())


def test_bounds_rule_cells_out(spark, tmp_path):
    r = random.Random(3)
    rows = list(enumerate(clustered(r, 30, 25, width=0.01)))
    index = vector_index.write_index(table(spark, rows), str(tmp_path / "index"), cells=30)
    units = np.array([v for _, v in rows])
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    assert (vector_index._enough(index, units, 5)[0] >= vector_index._apart(units, index.centres).min(1)).all()
    best = np.sort(units @ units.T, axis=1)[:, -6]
    apart = vector_index._apart(units, index.centres)
    seen = vector_index.visits(index.low, index.high, apart, np.sqrt(2 - 2 * best))
    assert (seen * index.sizes).sum() < 0.25 * len(rows) ** 2  # rows that are compared, of all pairs
    assert seen[np.arange(len(rows)), apart.argmin(1)].all()


def test_blocks_strings_and_nothing(spark, tmp_path, monkeypatch):
    r = random.Random(1)
    rows = list(enumerate(clustered(r, 6, 15)))
    v = table(spark, rows)
    index = vector_index.write_index(v, str(tmp_path / "a"))
    whole = sorted(map(tuple, vector_index.search(index, v, 3).select("query_id", "id", "rank").collect()))
    monkeypatch.setattr(vector_index, "BLOCK_BYTES", 20 * 8 * 8)
    assert sorted(map(tuple, vector_index.search(index, v, 3).select("query_id", "id", "rank").collect())) == whole
    named = v.selectExpr("concat('v', vec_id) vec_id", "embedding")
    got = vector_index.search(vector_index.write_index(named, str(tmp_path / "b")), named.filter("vec_id = 'v7'"), 2)
    assert [x["id"] for x in got.orderBy("rank").collect()] == [f"v{b}" for a, b, n in whole if a == 7 and n <= 2]
    none = vector_index.write_index(v.limit(0), str(tmp_path / "c"))
    assert vector_index.search(none, v, 3).collect() == [] and vector_index.search(index, v.limit(0), 3).collect() == []
