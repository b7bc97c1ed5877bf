"""Closest names by a similarity join: pairs that can be close enough are found by equi-joins, and only these are compared.

The likeness of two names is twice the characters that they match in order, over both lengths, and at most twice the characters that they share at all.
Characters numbered by their occurrence ("a1", "a2") make a name a set, so a least likeness bounds the size of the common set, and two such names share
one of their few rarest members: the prefix that they are joined on. Names of the same characters in another order (numbered names have many) are one set,
which is joined once. Lengths and common sets are checked in the join; what is left is compared in Arrow batches, most promising pairs first.

The closest name is mostly at hand: names that differ by at most one character left out meet in an equi-join of their own, and a name
for which no other key can be closer than that isn't looked for among all sets.
"""

from __future__ import annotations

import difflib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from supplymesh.functions.names import let

#: What rounding may change in a bound.
SLACK = 1e-9
#: Names up to this length are looked for with one character left out; longer ones only among all sets, as each would make as many strings as it has characters.
SHORT = 100
#: Names whose best key a task remembers, and characters of names that it compares at once.
REMEMBERED, AT_ONCE = 100_000, 1 << 21


def numbered_letters(name: Column) -> Column:
    """The characters of a name, each with the number of its occurrence."""
    number = lambda cs, c, i: F.size(F.filter(F.slice(cs, F.lit(1), i + 1), lambda d: d == c))
    return let(F.filter(F.split(name, ""), lambda c: c != ""), lambda cs: F.transform(cs, lambda c, i: F.concat(c, number(cs, c, i).cast("string"))))


def same_letters(name: Column) -> Column:
    """The characters of a name in order of characters: one string for all names that are made of the same ones."""
    return F.array_join(F.array_sort(F.filter(F.split(name, ""), lambda c: c != "")), "")


def _prefixed(sets: DataFrame, name: str, rarity: DataFrame, cutoff: float) -> DataFrame:
    """(name, letters, prefix): letters by rising frequency, and how many of them a close partner must share one of."""
    each = sets.select(name, F.explode(numbered_letters(F.col(name))).alias("letter")).join(rarity, "letter", "left")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(F.coalesce("often", F.lit(0)).alias("o"), F.col("letter").alias("l")))), lambda x: x["l"])
    n = F.size("letters")
    first = n - F.ceil(n * (cutoff / (2 - cutoff)) - SLACK).cast("int") + 1
    return each.groupBy(name).agg(ordered.alias("letters")).select(name, "letters", F.slice("letters", F.lit(1), first).alias("prefix"))


def candidates(names: DataFrame, keys: DataFrame, cutoff: float) -> DataFrame:
    """Distinct pairs (name, key) that share enough characters; no other pair can have a likeness of cutoff. ``names`` and ``keys`` have one column each, name and key.

    A pair of sets comes out once, at the first member that both prefixes have. Frequent members are joined by Spark's skew handling, as nothing is grouped above the join."""
    wanted = names.select("name").filter("name <> ''").distinct().withColumn("name_set", same_letters(F.col("name")))
    known = keys.select("key").filter("key <> ''").distinct().withColumn("key_set", same_letters(F.col("key")))
    name_sets, key_sets = wanted.select("name_set").distinct(), known.select("key_set").distinct()
    rarity = key_sets.select(F.explode(numbered_letters(F.col("key_set"))).alias("letter")).groupBy("letter").agg(F.count("*").alias("often"))
    a = _prefixed(name_sets, "name_set", rarity, cutoff).select("name_set", F.col("letters").alias("a"), F.col("prefix").alias("p"), F.explode("prefix").alias("letter"))
    b = _prefixed(key_sets, "key_set", rarity, cutoff).select("key_set", F.col("letters").alias("b"), F.col("prefix").alias("q"), F.explode("prefix").alias("letter"))
    n, m = F.size("a"), F.size("b")
    enough = (F.least(n, m) >= F.greatest(n, m) * (cutoff / (2 - cutoff)) - SLACK) & (F.get(F.array_intersect("p", "q"), F.lit(0)) == F.col("letter"))
    sets = a.join(b, "letter").filter(enough).filter(2 * F.size(F.array_intersect("a", "b")) >= (n + m) * cutoff - SLACK).select("name_set", "key_set")
    return wanted.join(sets, "name_set").join(known, "key_set").select("name", "key")


def likeness(name: pd.Series, key: pd.Series) -> pd.Series:
    """difflib's ratio of each key to each name; rows of one name in a row share its preparation."""
    compared, out, last = difflib.SequenceMatcher(), [], None
    for a, b in zip(name, key):
        if a != last:
            compared.set_seq2(a)
            last = a
        compared.set_seq1(b)
        out.append(compared.ratio())
    return pd.Series(out, dtype="float64")


def _codes(names: list[str], width: int, pad: int) -> np.ndarray:
    """Code points by place and name; places behind a name's end hold ``pad``."""
    codes = np.array(names, dtype=f"U{width}").view(np.uint32).reshape(len(names), width).T.copy()
    codes[np.arange(width)[:, None] >= np.array([len(x) for x in names])] = pad
    return codes


def most_likeness(name: pd.Series, key: pd.Series) -> np.ndarray:
    """What difflib's ratio can't exceed: the same figure from the longest common subsequence, of which matched blocks are one. All pairs of like length are worked out at once."""
    names, keys = name.tolist(), key.tolist()
    n, m = (np.array([len(x) for x in t], dtype="int64") for t in (names, keys))
    common, order = np.zeros(len(names), dtype="int64"), np.lexsort((m, n))
    rising, at = n[order], 0
    while at < len(order):
        width = (int(rising[at]) + 7) // 8 * 8
        end = min(int(np.searchsorted(rising, width, side="right")), at + max(1, AT_ONCE // width))
        part = order[at:end]
        a, b = _codes([names[i] for i in part], width, 0x110000), _codes([keys[i] for i in part], max(1, int(m[part].max())), 0x110001)
        row = np.zeros((width + 1, len(part)), dtype="int32")
        for letter in b:
            before = row.copy()
            for i in range(width):
                np.maximum(before[i + 1], before[i] + (a[i] == letter), out=row[i + 1])
                np.maximum(row[i + 1], row[i], out=row[i + 1])
        common[part] = row[-1]
        at = end
    return 2.0 * common / np.maximum(n + m, 1)


def _winners(cutoff: float):
    """Of batches of pairs those that can be the closest of their name: a pair that can't come up to the best one that the task has seen isn't compared."""

    def run(batches):
        compared, best, last = difflib.SequenceMatcher(), {}, None
        for pairs in batches:
            most = most_likeness(pairs["name"], pairs["key"])
            pairs = pairs.assign(most=most)[most >= cutoff].sort_values(["name", "most", "key"], ascending=[True, False, False])
            better = {}
            for name, key, most in pairs.itertuples(index=False):
                if (most, key) <= best.get(name, (cutoff, "")):
                    continue
                if name != last:
                    compared.set_seq2(name)
                    last = name
                compared.set_seq1(key)
                found = (compared.ratio(), key)
                if found > best.get(name, (cutoff, "")):
                    best[name] = better[name] = found
            yield pd.DataFrame([(x, k, r) for x, (r, k) in better.items()], columns=["name", "key", "ratio"])
            if len(best) > REMEMBERED:
                best.clear()

    return run


def _best(compared: DataFrame) -> DataFrame:
    return compared.groupBy("name").agg(F.max(F.struct("ratio", "key")).alias("best")).select("name", "best.key", "best.ratio")


def _one_off(names: DataFrame, keys: DataFrame) -> DataFrame:
    """Distinct pairs (name, key) that are equal, or of which one is the other without one of its characters; names up to SHORT only."""

    def shorter(c):
        return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.concat(F.substr(c, F.lit(1), i - 1), F.substr(c, i + 1))))

    short = names.filter(F.length("name") <= SHORT)
    less = short.select("name", F.explode(F.concat(F.array("name"), shorter(F.col("name")))).alias("key")).join(keys, "key").select("name", "key")
    more = keys.filter(F.length("key") <= SHORT + 1).select("key", F.explode(shorter(F.col("key"))).alias("name")).join(short, "name").select("name", "key")
    return less.unionByName(more)


def closest(names: DataFrame, keys: DataFrame, cutoff: float = 0.88) -> DataFrame:
    """For each distinct name with a key of at least this likeness the closest one: name, key, ratio; of equally close keys the last in order of characters.

    A key that differs by two characters or more from a name of n has a likeness of n / (n + 1) at most. So a name is done after the first join if the longest
    and last key there that it has all or all but one of its characters in common with also has so much likeness."""
    wanted, known = names.select("name").filter("name <> ''").distinct(), keys.select("key").filter("key <> ''").distinct()
    n, m = F.length("name"), F.length("key")
    near = _best(_one_off(wanted, known).withColumn("ratio", 2.0 * F.least(n, m) / (n + m)))
    done = near.filter((F.col("ratio") >= cutoff) & (F.col("ratio") > n / (n + 1) + SLACK)).filter(F.pandas_udf(likeness, "double")("name", "key") == F.col("ratio"))
    rest = candidates(wanted.join(done, "name", "left_anti"), known, cutoff).mapInPandas(_winners(cutoff), "name string, key string, ratio double")
    return done.unionByName(_best(rest))
