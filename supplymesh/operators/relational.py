"""Operators on any tables, by column names. Order, where it matters, is a column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from supplymesh.sources.scratch import settled


def _columns(names: Sequence[str | Column]) -> list[Column]:
    return [F.col(n) if isinstance(n, str) else n for n in names]


def best_per_key(df: DataFrame, keys: Sequence[str], score: str, ties: Sequence[str]) -> DataFrame:
    """The row of greatest score for each key, the first by ``ties`` if several have it. One aggregation, partial before the shuffle.
    A null score is less than any."""
    return topk_per_key(df, keys, [F.col(score).desc_nulls_last(), *_columns(ties)], 1)


def topk_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], k: int, rank: str | None = None) -> DataFrame:
    """The first k rows of each key in the given order; Spark limits each group before its shuffle. ``rank``: a column for their numbers from 1."""
    name = rank or "__rank"
    out = df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*_columns(order)))).filter(F.col(name) <= k)
    return out if rank else out.drop(name)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """Rows of which no earlier one has the same key."""
    return topk_per_key(df, keys, order, 1)


def last_per_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """The row of each key that is last in order: what a map keeps that is filled row by row."""
    row = F.struct(*[c for c in df.columns if c != key])
    return df.groupBy(key).agg(F.max_by(row, order).alias("__row")).select(key, "__row.*")


def two_key_left_join(left: DataFrame, right: DataFrame, left_keys: tuple[str, str], right_keys: tuple[str, str], order: str, take: Sequence[str]) -> DataFrame:
    """left with ``take`` of the right row found by its first key, else by its second; null if neither is found.

    Each right row is known by both of its keys, and the last one in ``order`` counts for a key. Two equi-joins, where a
    join on either key would compare all pairs.
    """
    known = right.select(F.explode(F.array_distinct(F.array(*right_keys))).alias("__key"), F.struct(F.lit(True).alias("found"), *take).alias("__row"), F.col(order).alias("__order"))
    last = known.filter(F.col("__key").isNotNull()).groupBy("__key").agg(F.max_by("__row", "__order").alias("__row"))
    out = left
    for i, key in enumerate(left_keys):
        out = out.join(last.select(F.col("__key").alias(f"__k{i}"), F.col("__row").alias(f"__r{i}")), F.col(key) == F.col(f"__k{i}"), "left")
    row = F.when(F.col("__r0.found"), F.col("__r0")).otherwise(F.col("__r1"))
    kept = [c for c in left.columns if c not in take]
    return out.withColumn("__row", row).select(*kept, *(F.col(f"__row.{c}").alias(c) for c in take))


def semi_if_any(left: DataFrame, right: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Rows of left that have a match; all of them if right is empty."""
    none = right.limit(1).agg((F.count("*") == 0).alias("__none"))
    keys = [on] if isinstance(on, str) else list(on)
    marked = left.join(right.select(*keys).distinct().withColumn("__hit", F.lit(True)), keys, "left").join(F.broadcast(none))  # one row
    return marked.filter(F.col("__hit").isNotNull() | F.col("__none")).select(*left.columns)


def merge_groups(df: DataFrame, key: str, order: str, *, unions: Sequence[str] = (), maxima: Sequence[str] = (), joined: dict[str, str] | None = None, firsts: dict[str, str] | None = None) -> DataFrame:
    """One row for each key, with its number of rows as ``members``.

    ``unions``: arrays, as the sorted set of all their items. ``maxima``: the greatest value. ``joined``: name -> separator:
    distinct non-empty strings in order. ``firsts``: name -> value that doesn't count: the first other value that isn't null, else the first row's.

    Counts, maxima and firsts are added up before the shuffle. Sets are made in two steps: each item of a key once, with its least order, then the key's items together, so that
    a key with very many rows is dealt by item, and only distinct items ever meet.
    """
    parts = [F.count("*").alias("members"), *(F.max(c).alias(c) for c in maxima)]
    for c, unknown in (firsts or {}).items():
        at = F.struct(F.col(order), F.col(c))
        told = F.col(c).isNotNull() & (F.col(c) != "") & (F.col(c) != unknown)
        boxed = F.struct(F.col(c).alias("x"))
        parts.append(F.coalesce(F.min_by(c, F.when(told, at)), F.min_by(boxed, at)["x"]).alias(c))
    out = df.groupBy(key).agg(*parts)
    for c in unions:
        items = df.select(F.col(key).alias("__key"), F.explode(c).alias("__item")).distinct()
        out = _with_part(out, key, items.groupBy("__key").agg(F.array_sort(F.collect_list("__item")).alias("__made")), c, F.array().cast(df.schema[c].dataType))
    for c, gap in (joined or {}).items():
        items = df.filter(F.col(c).isNotNull() & (F.col(c) != "")).groupBy(F.col(key).alias("__key"), F.col(c).alias("__item")).agg(F.min(order).alias("__order"))
        inorder = F.transform(F.array_sort(F.collect_list(F.struct("__order", "__item"))), lambda r: r["__item"])
        out = _with_part(out, key, items.groupBy("__key").agg(F.array_join(inorder, gap).alias("__made")), c, F.lit(""))
    return out


def _with_part(out: DataFrame, key: str, part: DataFrame, name: str, none: Column) -> DataFrame:
    both = out.join(part, F.col(key).eqNullSafe(F.col("__key")), "left")
    return both.withColumn(name, F.coalesce("__made", none)).drop("__key", "__made")


def first_items_per_field(rows: DataFrame, key: str, items: str, field: str, order: str, out: str) -> DataFrame:
    """For each key the items of its arrays of structs, in order, the first one for each value of a field; null is one value."""
    each = rows.select(key, order, F.posexplode(items).alias("__at", "__item")).withColumn("__f", F.col(f"__item.{field}"))
    first = topk_per_key(each, [key, "__f"], [order, "__at"], 1)
    return first.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("__at").alias("a"), F.col("__item").alias("x")))), lambda r: r["x"]).alias(out))


def delta_from_previous(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str], suffix: str = "_delta") -> DataFrame:
    """df with the change of each value against the row before it; 0 for a key's first row."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumns({f"{v}{suffix}": F.coalesce(F.col(v) - F.lag(v).over(w), F.lit(0)) for v in values})


def distinct_on(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The first row of each combination of keys."""
    return first_per_key(df, keys, order)


def sole_sources(edges: DataFrame, supplier: str, product: str, *also: Column) -> DataFrame:
    """Each supplier's number of products, how many of them have one entry only, and the fewest entries of any; ``also``: further aggregates of its entries.
    Entries are counted by a window, so that they are computed and shuffled once; entries without a product count for none."""
    entries = F.count("*").over(W.partitionBy(product))
    counted = edges.filter(F.col(product).isNotNull()).withColumn("__entries", entries)
    return counted.groupBy(supplier).agg(F.count_distinct(product).alias("products"), F.count_if(F.col("__entries") == 1).alias("sole_products"), F.min("__entries").alias("fewest_entries"), *also)


def worst_level(df: DataFrame, key: str | Sequence[str], level: Column, out: str = "worst") -> DataFrame:
    """The greatest ordinal of each key, or combination of keys."""
    return df.groupBy(*([key] if isinstance(key, str) else key)).agg(F.max(level).alias(out))


def set_metrics(found: DataFrame, expected: DataFrame, key: str, item: str) -> DataFrame:
    """For each key the sizes of its found and expected sets, and what they share, lack and have beyond. A full outer join of distinct items."""
    f = found.select(key, item).distinct().withColumn("__f", F.lit(1))
    e = expected.select(key, item).distinct().withColumn("__e", F.lit(1))
    both = f.join(e, [key, item], "full")
    yes = lambda *c: F.count_if(F.expr(" and ".join(c)))
    return both.groupBy(key).agg(
        F.count("__f").alias("found"), F.count("__e").alias("expected"),
        yes("__f is not null", "__e is not null").alias("matched"), yes("__f is null").alias("missing"), yes("__e is null").alias("beyond"),
    )


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], out: str = "number") -> DataFrame:
    """df with each row's number from 1 within its keys."""
    return df.withColumn(out, F.row_number().over(W.partitionBy(*keys).orderBy(*_columns(order))))


def numbered_overall(df: DataFrame, order: Sequence[str | Column], name: str = "number") -> DataFrame:
    """df with each row's number in an order over the whole table, from 0. Rows are range-partitioned and numbered within their parts; the
    driver gets one count for each part."""
    ranged = settled(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id()))
    part, at = F.shiftright("__id", 33), F.col("__id").bitwiseAND((1 << 33) - 1)
    sizes = ranged.groupBy(part.alias("__part")).agg(F.count("*").alias("n")).orderBy("__part").collect()
    before = [(r["__part"], sum(x.n for x in sizes[:i])) for i, r in enumerate(sizes)]
    table = F.broadcast(df.sparkSession.createDataFrame(before, "__part long, __before long"))  # a row for each part
    return ranged.withColumn("__part", part).join(table, "__part").withColumn(name, at + F.col("__before")).drop("__id", "__part", "__before")
