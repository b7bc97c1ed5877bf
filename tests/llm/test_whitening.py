"""Whitening against numpy's eigenvectors of the exact covariance."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest

from supplymesh.llm import whitening
from supplymesh.llm.queries import op12_whitening

SHAPE = "vec_id long, embedding array<float>, component string, at long"


def plain(rows, k, scale=1024, shift=100_000):
    """(vec_id, deviation, whitened by component), shares: from whole numbers, centred before multiplying."""
    kept = [(r[0], [math.floor(scale * float(x)) + shift for x in r[1]]) for r in rows if r[1] and all(x is not None and math.isfinite(x) for x in r[1])]
    n, sums = len(kept), [sum(c) for c in zip(*(x for _, x in kept))]
    apart = [[n * a - s for a, s in zip(x, sums)] for _, x in kept]
    deviation = [sum(a * a for a in row) for row in apart]
    centred = np.array(apart, "f8") / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    total = float(Fraction(sum(deviation), n**3))
    return [i for i, _ in kept], deviation, centred @ vectors / np.sqrt(values), values / total


def test_against_numpy(spark):
    r = np.random.default_rng(8)
    mixed = r.normal(size=(300, 12)) @ np.diag(np.linspace(2, 0.2, 12)) @ r.normal(size=(12, 12)) + 900
    rows = [(i, [float(np.float32(x)) for x in v], "clash", 5) for i, v in enumerate(mixed)]
    rows += [(500 + i, rows[0][1], "copy", 5) for i in range(150)] + [(None, rows[3][1], None, None)]
    bad = [(900, None, "", 1), (901, [1.0] * 11 + [None], "", 1), (902, [math.nan] + [1.0] * 11, "", 1), (903, [1.0] * 11 + [-math.inf], "", 1), (904, [], "", 1), (905, [1.0], "", 1)]
    got = whitening.whitened_components(spark.createDataFrame(rows + bad, SHAPE).repartition(7)).collect()
    ids, deviation, white, shares = plain(rows, 8)
    assert len(got) == 8 * len(rows) and {g["n"] for g in got} == {len(rows)} and {g["at"] for g in got} == {5, None}
    assert len({g["identity_error"] for g in got}) == 1 and got[0]["identity_error"] < 1e-9
    by = {}
    for g in got:
        by.setdefault((g["vec_id"], g["component"]), []).append(g)
    signs = [np.sign(by[0, c + 1][0]["whitened"] * white[0, c]) for c in range(8)]
    for j, i in enumerate(ids):
        for c in range(8):
            for g in by[i, c + 1]:
                assert int(g["deviation"]) == deviation[j]
                assert g["whitened"] == pytest.approx(signs[c] * white[j, c], rel=1e-9, abs=1e-9)
                assert g["explained"] == pytest.approx(shares[c], rel=1e-10)


def test_few_rows_and_none(spark):
    flat = [(i, [0.5, 0.25], "", 0) for i in range(4)]
    for rows in ([], [(1, None, "", 0)], flat[:1], flat):
        assert whitening.whitened_components(spark.createDataFrame(rows, SHAPE)).collect() == []
    two = whitening.whitened_components(spark.createDataFrame([*flat, (9, [0.75, 0.25], "", 0)], SHAPE)).collect()
    assert {g["component"] for g in two} == {1} and two[0]["explained"] == pytest.approx(1)
    assert whitening.fit(spark.createDataFrame([(1, None)], "i int, embedding array<double>")) is None


def test_large_numbers_stay_exact(spark):
    r = random.Random(2)
    rows = [(i, [r.uniform(-1e9, 1e9), r.uniform(-1, 1)]) for i in range(20)]
    got = whitening.whitened_components(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    _, deviation, white, _ = plain(rows, 2)
    assert {(g["vec_id"], int(g["deviation"])) for g in got} == set(enumerate(deviation))
    assert {abs(round(g["whitened"], 7)) for g in got if g["component"] == 1} == {abs(round(float(x), 7)) for x in white[:, 0]}


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    got = op12_whitening(spark, sf)
    n = spark.read.parquet(f"{sf}/embeddings.parquet").count()
    assert got.count() == 8 * n and dict(got.dtypes)["deviation"] == "bigint" and got.first()["identity_error"] < 1e-4
