"""Whitening of embeddings: principal components from MLlib's singular value decomposition of centred rows.

Components become whole numbers x = floor(scale * c) + shift, so that counts, sums and deviations are exact in any order of rows.
Rows are centred before they enter the distributed matrix, as (n*x - S) / n with a whole numerator, so that a large shift costs no digits.
The variance of a component is its singular value squared, divided by n. The total variance, which explained shares refer to, comes from the
exact deviations instead, and the covariance of the whitened rows is measured afterwards, in a pass of its own.

Rows are left out whose vector is null, holds a null or an entry that isn't finite (or of 2^52 and more, which no whole number here holds),
or isn't as long as most vectors are (of equally common lengths the longer). Components whose variance can't be told from rounding errors aren't given, so
equal rows, or a single one, give no rows, and fewer rows or dimensions than components give fewer components.
"""

from __future__ import annotations

from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from supplymesh.llm.centroids import finite
from supplymesh.llm.common import prepare

LONG = 1 << 63


@dataclass(frozen=True)
class Whitening:
    """What is learned from a table: n rows with their sums by dimension, unit components (in rows) and variances, the total variance,
    the largest n*|x| and the largest |n*x - S|, and how vectors become whole numbers."""

    n: int
    sums: tuple[int, ...]
    components: np.ndarray
    variances: np.ndarray
    total: float
    most: int
    apart: int
    vector: str
    scale: int
    shift: int

    @property
    def dims(self) -> int:
        return len(self.sums)


def _whole(vector: Column, scale: int, shift: int) -> Column:
    return F.transform(vector, lambda c: F.floor(c.cast("double") * float(scale)) + F.lit(shift).cast("long"))


def _usable(df: DataFrame, vector: str) -> DataFrame:
    v = F.col(f"`{vector}`")
    return df.filter(finite(v)).filter(F.forall(v, lambda c: F.abs(c.cast("double")) < 2.0**52))


def _scaled(x: Column, model: Whitening) -> Column:
    """n*x - S by dimension: longs where they can't overflow, else decimals."""
    kind = "long" if max(model.most, model.apart) < LONG else "decimal(38,0)"
    sums = F.array(*(F.lit(str(s)).cast(kind) for s in model.sums))
    return F.zip_with(x.cast(f"array<{kind}>"), sums, lambda a, s: (F.lit(model.n).cast(kind) * a - s).cast(kind))


def _deviation(scaled: Column, model: Whitening) -> Column:
    """The sum of squares, exact: in longs where it fits, else in decimals."""
    kind = "long" if model.dims * model.apart * model.apart < LONG else "decimal(38,0)"
    return F.aggregate(scaled, F.lit(0).cast(kind), lambda s, t: (s + t.cast(kind) * t.cast(kind)).cast(kind)).cast("decimal(38,0)")


def _centred(df: DataFrame, model: Whitening) -> DataFrame:
    """df's usable rows as (row, scaled): the row as a struct, its vector as n*x - S."""
    rows = _usable(df, model.vector).filter(F.size(F.col(f"`{model.vector}`")) == model.dims)
    x = _whole(F.col(f"`{model.vector}`"), model.scale, model.shift)
    return rows.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), _scaled(x, model).alias("scaled"))


def _double(scaled: Column, n: int) -> Column:
    return F.transform(scaled, lambda t: t.cast("double") / float(n))


def fit(df: DataFrame, vector: str = "embedding", components: int = 8, scale: int = 1024, shift: int = 100_000) -> Whitening | None:
    """Learns from all rows with a usable vector; None if there are none. The driver gets some numbers for each dimension."""
    prepare(df.sparkSession)
    v = F.col(f"`{vector}`")
    usable = _usable(df.select(v.alias(vector)), vector)
    common = usable.groupBy(F.size(v).alias("size")).count().filter("size > 0").orderBy(F.desc("count"), F.desc("size")).first()
    if common is None:
        return None
    n, dims = common["count"], common["size"]
    x = usable.filter(F.size(v) == dims).select(F.posexplode(_whole(v, scale, shift)).alias("at", "x"))
    each = x.groupBy("at").agg(F.sum(F.col("x").cast("decimal(19,0)")).alias("s"), F.min("x").alias("low"), F.max("x").alias("high")).orderBy("at").collect()
    sums = tuple(int(r["s"]) for r in each)
    most = n * max(abs(r[end]) for r in each for end in ("low", "high"))
    apart = max(abs(n * r[end] - s) for r, s in zip(each, sums) for end in ("low", "high"))
    model = Whitening(n, sums, np.zeros((0, dims)), np.zeros(0), 0.0, most, apart, vector, scale, shift)

    centred = _centred(df.select(v.alias(vector)), model)
    total = centred.agg(F.sum(_deviation(F.col("scaled"), model))).first()[0]
    if not total:
        return model
    # All components are asked for: MLlib then decomposes the sum of squares by LAPACK to double precision, not by iterations with a tolerance.
    matrix = RowMatrix(MLUtils.convertVectorColumnsFromML(centred.select(array_to_vector(_double(F.col("scaled"), n)).alias("v")), "v"))
    svd = matrix.computeSVD(dims, False, float(np.sqrt(dims * np.finfo("f8").eps)))
    found = min(components, len(svd.s))
    directions = svd.V.toArray()[:, :found].T
    directions = directions / np.linalg.norm(directions, axis=1, keepdims=True)
    variances = svd.s.toArray()[:found] ** 2 / n
    return Whitening(n, sums, np.ascontiguousarray(directions), variances, float(Fraction(int(total), n**3)), most, apart, vector, scale, shift)


def whiten(df: DataFrame, model: Whitening, out: str = "whitened") -> DataFrame:
    """df's usable rows with ``out``, the whitened vector (array of doubles, an entry for each component), and ``deviation`` (decimal): the exact sum of (n*x - S)^2.
    Columns of these names in df are replaced."""
    turn = np.ascontiguousarray((model.components / np.sqrt(model.variances)[:, None]).T)

    @F.pandas_udf("array<double>")
    def turned(rows: pd.Series) -> pd.Series:
        return pd.Series(list(np.stack(rows.to_list()) @ turn) if len(rows) else [], dtype=object)

    centred = _centred(df, model)
    kept = [c for c in df.columns if c not in (out, "deviation")]
    made = centred.select("row", _deviation(F.col("scaled"), model).alias("deviation"), turned(_double(F.col("scaled"), model.n)).alias("white"))
    return made.select(*(F.col(f"row.`{c}`") for c in kept), F.col("white").alias(out), "deviation")


def identity_error(whitened: DataFrame, count: int, column: str = "whitened") -> float:
    """The largest absolute entry of the whitened rows' covariance (centred, divisor n) minus the identity."""
    pairs = [(i, j) for i in range(count) for j in range(i + 1)]
    at = whitened.select(*(F.get(F.col(column), F.lit(i)).alias(f"c{i}") for i in range(count)))
    found = at.agg(*(F.covar_pop(f"c{i}", f"c{j}").alias(f"v{i}_{j}") for i, j in pairs)).first()
    return max(abs(found[f"v{i}_{j}"] - (i == j)) for i, j in pairs)


def whitened_components(df: DataFrame, vector: str = "embedding", components: int = 8, scale: int = 1024, shift: int = 100_000) -> DataFrame:
    """A row for each usable row of df and each component from 1: df's columns but the vector, and component int, n long, deviation decimal, whitened double,
    explained double (the component's share of the total variance), identity_error double. Columns of these names in df are replaced."""
    added = ["component", "n", "deviation", "whitened", "explained", "identity_error"]
    kept = [F.col(f"`{c}`") for c in df.columns if c not in (vector, *added)]
    model = fit(df, vector, components, scale, shift)
    if model is None or not len(model.variances):
        blank = ("int", "long", "decimal(38,0)", "double", "double", "double")
        return df.limit(0).select(*kept, *(F.lit(0).cast(t).alias(c) for c, t in zip(added, blank)))
    rows = whiten(df, model)
    error = identity_error(rows, len(model.variances))
    shares = F.array(*(F.lit(float(e / model.total)) for e in model.variances))
    each = rows.select(F.struct(F.lit(0).alias("none"), *kept).alias("row"), "deviation", F.posexplode("whitened").alias("at", "white"))
    names = [c for c in df.columns if c not in (vector, *added)]
    return each.select(
        *(F.col(f"row.`{c}`") for c in names), (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation",
        F.col("white").alias("whitened"), F.get(shares, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"),
    )
