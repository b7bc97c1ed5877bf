"""Rounding of doubles: Spark's own, and one that looks at the exact binary value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def py_round(value: Column, digits: int = 2, exact: bool = False) -> Column:
    """``exact``: to the nearest decimal of the double's exact binary value, ties to even, in Python; else Spark's rounding of its shortest decimal form."""
    if not exact:
        return F.round(value, digits)

    @F.pandas_udf("double")
    def rounded(x):
        return x.map(lambda v: None if v is None or v != v else round(float(v), digits))

    return rounded(value.cast("double"))
