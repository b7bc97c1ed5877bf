"""Entity resolution: names to canonical identities by key, initials, and closeness."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from supplymesh.functions import names as N
from supplymesh.operators.fuzzy import closest
from supplymesh.sources import reference_data as R

#: Least likeness at which an unresolved name takes the identity of the closest key.
CLOSE = 0.88
#: Aliases up to which their table is broadcast; a larger one is joined by shuffles.
BROADCAST_NAMES = 100_000


def compact(name: str) -> str:
    return re.sub(r"[^a-z0-9]+", " ", (name or "").lower()).strip()


class Identities:
    """An alias table in the forms that lookups need: keys, initials and variants. It is a dimension, of a size the driver knows."""

    def __init__(self, spark: SparkSession, pairs: list[tuple[str, str]] | None = None, display: dict[str, str] | None = None):
        self.spark, self.pairs = spark, pairs if pairs is not None else R.identities()
        self.display = display if display is not None else R.display_names()
        raw = spark.createDataFrame([(i, a, c) for i, (a, c) in enumerate(self.pairs)], "i int, alias string, canonical string")
        both = raw.select("i", "canonical", F.explode(F.array("alias", "canonical")).alias("name"))
        rows = both.select("i", "canonical", N.compact_key(F.col("name")).alias("a"), N.compact_key(N.normalize_name(F.col("name"))).alias("b"), N.initials(F.col("name")).alias("initials")).collect()
        self.keys: dict[str, str] = {}
        self.initials: dict[str, str] = {}
        for r in sorted(rows, key=lambda r: r.i):
            self.keys.update({k: r.canonical for k in (r.a, r.b) if k})
            if r.initials:
                self.initials.setdefault(r.initials, r.canonical)

    def _frame(self, table: dict[str, str], key: str, value: str) -> DataFrame:
        made = self.spark.createDataFrame(list(table.items()) or [("", "")], f"{key} string, {value} string")
        return F.broadcast(made) if len(table) <= BROADCAST_NAMES else made

    def resolve(self, df: DataFrame, name: str, out: str = "canonical", fuzzy: bool = True) -> DataFrame:
        """df with the canonical name of a column: by key, else by key without suffixes, else by initials, else the closest key; else the name itself, squeezed.

        Only distinct names that nothing exact resolves are compared with keys, by a join that leaves out those which can't be close."""
        clean = N.squeezed(F.col(name))
        steps = df.drop(out).withColumns({"__clean": clean, "__a": N.compact_key(clean), "__b": N.compact_key(N.normalize_name(clean)), "__i": F.replace(F.upper(clean), F.lit("."), F.lit(""))})
        for key, table in (("__a", self.keys), ("__b", self.keys), ("__i", self.initials)):
            steps = steps.join(self._frame(table, key, f"{key}_found"), key, "left")
        found = F.coalesce("__a_found", "__b_found", F.when(F.col("__i") != "", F.col("__i_found")))
        if not fuzzy:
            return steps.withColumn(out, F.coalesce(found, "__clean")).select(*[c for c in df.columns if c != out], out)
        steps = steps.withColumn("__found", found)
        unknown = steps.filter(F.col("__found").isNull()).select(F.col("__a").alias("name"))
        known = self._frame(self.keys, "key", "__close")
        close = closest(unknown, known.select("key"), CLOSE).join(known, "key").select(F.col("name").alias("__open"), "__close")
        steps = steps.join(close, F.col("__a") == F.col("__open"), "left")
        return steps.withColumn(out, F.coalesce("__found", "__close", "__clean")).select(*[c for c in df.columns if c != out], out)

    def display_name(self, canonical: Column) -> Column:
        table = F.create_map(*(F.lit(x) for kv in self.display.items() for x in kv)) if self.display else None
        return canonical if table is None else F.coalesce(F.try_element_at(table, canonical), canonical)

    def is_known(self, name: Column, canonical: Column) -> Column:
        keys = list(self.keys)
        return N.compact_key(name).isin(keys) | N.compact_key(canonical).isin(keys) | canonical.isin(sorted(set(c for _, c in self.pairs)))

    def with_variants(self, df: DataFrame, canonical: str, out: str = "variants") -> DataFrame:
        """df with every way to write a canonical name: aliases, short names, its first words; lower case, of two letters at least."""
        known = {}
        for c in dict.fromkeys(c for _, c in self.pairs):
            known[c] = [c, self.display.get(c, ""), *(a for a, x in self.pairs if x == c), *N.canonical_variants(c)]
            known[c] += [k for k, v in R.company_aliases().items() if v == c or compact(v) == compact(c)]
        table = self.spark.createDataFrame([(c, v) for c, v in known.items()], "__canonical string, __known array<string>")
        table = F.broadcast(table) if len(self.pairs) <= BROADCAST_NAMES else table
        name = F.col(canonical)
        words = F.split(name, r"\s+")
        own = F.array(name, N.compact_key(name), F.array_join(F.slice(words, 1, 2), " "), F.array_join(F.slice(words, 1, 3), " "))
        every = F.concat(own, F.coalesce("__known", F.array().cast("array<string>")))
        joined = df.join(table, name == F.col("__canonical"), "left")
        return joined.withColumn(out, F.array_sort(F.array_distinct(F.filter(F.transform(every, F.lower), lambda x: F.length(x) >= 2)))).drop("__canonical", "__known")
