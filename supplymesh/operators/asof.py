"""As-of joins: each row with the last row of the other side that isn't later, also where one key has most of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from supplymesh.sources.scratch import settled


def asof_join(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, take: Sequence[str], ties: Sequence[str] = (), allow_equal: bool = True) -> DataFrame:
    """left with the ``take`` columns of the right row that has its key and the greatest time up to its own (before it, without allow_equal); of several such rows the last by ``ties``.
    null where there is none, where the key is null, or the time. Right rows without a key or a time count for nothing. ``take`` columns replace left ones of their names.

    Both sides become one table, range-partitioned by key and time, so that a key with many rows is several parts. Within a part the last right row is carried on by a window; into a part that
    begins amid a key, it comes from an earlier part by a table of two rows for each part, which is broadcast."""
    kept = [c for c in left.columns if c not in take]
    row = F.struct(*(F.col(f"`{c}`") for c in kept))
    value = F.struct(*(F.col(f"`{c}`") for c in take))
    tie = F.struct(*(F.col(f"`{c}`") for c in ties)) if ties else F.lit(0)
    early, late = (0, 1) if allow_equal else (1, 0)
    know = right.filter(F.col(key).isNotNull() & F.col(right_time).isNotNull()).select(F.col(key).alias("key"), F.col(right_time).alias("time"), F.lit(early).alias("side"), tie.alias("tie"), value.alias("value"))
    ask = left.select(F.col(key).alias("key"), F.col(left_time).alias("time"), F.lit(late).alias("side"), row.alias("row"))
    open_rows = ask.filter(F.col("key").isNotNull() & F.col("time").isNotNull())
    order = ["time", "side", "tie"]
    both = know.unionByName(open_rows, allowMissingColumns=True)
    parts = settled(both.repartitionByRange("key", *order).withColumn("part", F.spark_partition_id()))
    inside = F.last("value", ignorenulls=True).over(W.partitionBy("part", "key").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    filled = parts.withColumn("inside", inside).filter(F.col("row").isNotNull())

    ends = parts.groupBy("part").agg(F.min("key").alias("low"), F.max("key").alias("high"))
    border = parts.join(F.broadcast(ends), "part").filter((F.col("key") == F.col("low")) | (F.col("key") == F.col("high")))  # a row for each part is broadcast
    last = border.groupBy("part", "key").agg(F.max_by("value", F.when(F.col("value").isNotNull(), F.struct(*order))).alias("last"))
    before = F.last("last", ignorenulls=True).over(W.partitionBy("key").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    carried = last.withColumn("carried", before).filter(F.col("carried").isNotNull()).select("part", "key", "carried")
    found = filled.join(F.broadcast(carried), ["part", "key"], "left").select("row", F.coalesce("inside", "carried").alias("value"))  # two rows for each part at most
    rest = ask.filter(F.col("key").isNull() | F.col("time").isNull()).select("row", F.lit(None).cast(dict(know.dtypes)["value"]).alias("value"))
    return found.unionByName(rest).select("row.*", *(F.col(f"value.`{c}`") for c in take))
