"""Many patterns over many texts: a text is read once for literals, and only patterns that it can match are run.

Whatever matches a pattern has one of some literals in it, which follow from the pattern. All literals of all patterns form one Aho-Corasick automaton; the literals that a
text has name the patterns that are worth a look. Most texts have none, and cost one pass however many patterns there are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from re import _constants as sre
from re import _parser as parser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from supplymesh.functions import evidence as E
from supplymesh.sources import reference_data as R


def needed_literals(pattern: str) -> frozenset[str]:
    """Lower-case literals of which every match of the pattern has one; empty if none can be told."""
    return _needed(parser.parse(pattern, re.IGNORECASE))


def _needed(parts) -> frozenset[str]:
    options: list[frozenset[str]] = []
    run = ""

    def flush() -> None:
        nonlocal run
        if run:
            options.append(frozenset([run]))
        run = ""

    for kind, what in parts:
        if kind is sre.LITERAL:
            run += chr(what).lower()
            continue
        flush()
        if kind is sre.SUBPATTERN:
            options.append(_needed(what[-1]))
        elif kind in (sre.MAX_REPEAT, sre.MIN_REPEAT) and what[0] >= 1:
            options.append(_needed(what[2]))
        elif kind is sre.BRANCH:
            each = [_needed(x) for x in what[1]]
            options.append(frozenset().union(*each) if all(each) else frozenset())
    flush()
    return max((x for x in options if x), key=lambda x: min(map(len, x)), default=frozenset())


class PatternIndex:
    """Patterns in groups, found by their literals; patterns without any are always run."""

    def __init__(self, groups: dict[str, Sequence[str]]):
        import ahocorasick

        self.names = list(groups)
        self.patterns = [(g, re.compile(p, re.IGNORECASE)) for g, own in enumerate(groups.values()) for p in own]
        of: dict[str, list[int]] = {}
        self.always = []
        for i, p in enumerate(p for own in groups.values() for p in own):
            literals = needed_literals(p)
            for x in literals:
                of.setdefault(x, []).append(i)
            if not literals:
                self.always.append(i)
        self.found = ahocorasick.Automaton()
        for x, own in of.items():
            self.found.add_word(x, tuple(own))
        if of:
            self.found.make_automaton()
        self.literals = len(of)

    def counts(self, text: str) -> list[int]:
        """How many patterns of each group a text matches."""
        low = text.lower()
        near = set(self.always)
        if self.literals:
            for _, own in self.found.iter(low):
                near.update(own)
        out = [0] * len(self.names)
        for i in near:
            group, pattern = self.patterns[i]
            out[group] += pattern.search(low) is not None
        return out


def with_pattern_counts(df: DataFrame, texts: Column, groups: dict[str, Sequence[str]], out: str = "signals") -> DataFrame:
    """df with an array of structs, for each of a row's texts (an array of strings) how many patterns of each group it matches, anywhere and in any case; a null text matches none, a null array is empty.
    A column of the array's name is replaced. Row by row, in Arrow batches; the patterns are a fixed list that goes to every task."""
    kept = df.drop(out)
    row = F.struct(*(F.col(f"`{c}`") for c in kept.columns)).alias("row")
    plain = df.select(row, F.coalesce(texts, F.array().cast("array<string>")).alias("texts"))
    found = T.ArrayType(T.StructType([T.StructField(g, T.IntegerType()) for g in groups]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = PatternIndex(groups)
        kind = pa.list_(pa.struct([(g, pa.int32()) for g in groups]))
        for b in batches:
            told = [[dict(zip(index.names, index.counts(t or ""))) for t in own] for own in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(told, kind)], names=["row", "found"])

    schema = T.StructType([plain.schema["row"], T.StructField("found", found)])
    return plain.mapInArrow(run, schema).select("row.*", F.col("found").alias(out))


def with_analysis(df: DataFrame, items: str = "evidence", out: str = "analysis") -> DataFrame:
    """df with what evidence.analysis() gives for a column of evidence items, by the patterns' literals: for tables with much text, of which each item is read once and not once for
    each pattern. A column of the struct's name is replaced."""
    groups = {"strong": R.STRONG, "medium": R.MEDIUM, "weak": R.WEAK, "against": R.AGAINST}
    counted = with_pattern_counts(df, E.item_texts(F.col(items)), groups, out)
    once = F.transform(F.col(out), lambda x: x.withField("against", F.least(x["against"], F.lit(1))))
    return counted.withColumn(out, E.totals(once))
