"""Control of a run: stages with time limits, budgets, plug-in points."""

from __future__ import annotations

import threading
import time
from collections.abc import Iterator
from contextlib import contextmanager
from typing import Protocol

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from supplymesh.sources.scratch import settled


class RiskProvider(Protocol):
    """Risks (supplier_name, canonical, seq, risk_type, severity, confidence, reasoning, mitigation) of suppliers; stays in columns where it can."""

    def __call__(self, suppliers: DataFrame) -> DataFrame: ...


class VerificationProvider(Protocol):
    """Confidence that companies exist: (canonical, provider, verified, confidence, reasoning)."""

    def __call__(self, suppliers: DataFrame) -> DataFrame: ...


class Classifier(Protocol):
    """Relationships (canonical, relationship_type, confidence_score, reasoning) by evidence; a model goes behind ``mapInArrow``."""

    def __call__(self, evidence: DataFrame) -> DataFrame: ...


def all_risks(suppliers: DataFrame, providers: list[RiskProvider]) -> DataFrame:
    """The providers' risks one after the other; a risk that a provider gives twice counts once."""
    out = None
    for provider in providers:
        once = provider(suppliers).dropDuplicates(["supplier_name", "risk_type", "severity", "reasoning"])
        out = once if out is None else out.unionByName(once)
    if out is None:
        raise ValueError("no provider")
    return out


class Stages:
    """Seconds of each stage. A stage that takes longer than its limit has its jobs cancelled, and is noted as timed out."""

    def __init__(self, spark: SparkSession, limit: float = 180.0):
        self.spark, self.limit = spark, limit
        self.seconds: dict[str, float] = {}
        self.timed_out: list[str] = []

    @contextmanager
    def stage(self, name: str) -> Iterator[None]:
        sc, began = self.spark.sparkContext, time.monotonic()
        sc.setJobGroup(name, name, interruptOnCancel=True)
        timer = threading.Timer(self.limit, self._stop, [name])
        timer.start()
        try:
            yield
        except Exception:
            if name not in self.timed_out:
                raise
        finally:
            timer.cancel()
            sc.setLocalProperty("spark.jobGroup.id", None)
            self.seconds[name] = self.seconds.get(name, 0.0) + time.monotonic() - began

    def _stop(self, name: str) -> None:
        self.timed_out.append(name)
        self.spark.sparkContext.cancelJobGroup(name)

    def table(self) -> DataFrame:
        rows = [(i, n, round(s, 3), n in self.timed_out) for i, (n, s) in enumerate([*self.seconds.items(), ("total", sum(self.seconds.values()))])]
        return self.spark.createDataFrame(rows, "seq int, stage string, seconds double, timed_out boolean")


def within_budget(rows: DataFrame, order: list[str], most: int, key: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The first ``most`` rows in order, of each key if given, and one audit row (key, dropped) for each budget that didn't suffice."""
    if not key:
        audit = rows.agg(F.greatest(F.count("*") - most, F.lit(0)).alias("dropped")).filter("dropped > 0").select(F.lit("all").alias("key"), "dropped")
        return rows.orderBy(*order).limit(most), audit
    w = W.partitionBy(key).orderBy(*order)
    numbered = rows.withColumn("__n", F.row_number().over(w))
    audit = numbered.groupBy(F.col(key).cast("string").alias("key")).agg(F.count_if(F.col("__n") > most).alias("dropped")).filter("dropped > 0")
    return numbered.filter(F.col("__n") <= most).drop("__n"), audit


def observed_budget(rows: DataFrame, key: str, order: list[str], most: int) -> tuple[DataFrame, DataFrame]:
    """The first ``most`` rows of each key in order, and one audit row (seen, kept, dropped) about all of them. The counts are observed while the rows are chosen and written, so nothing is
    read twice, and Spark still limits each key before its shuffle, as nothing is counted between ranking and limit."""
    seen, left = Observation(), Observation()
    counted = rows.observe(seen, F.count(F.lit(1)).alias("n"))
    ranked = counted.withColumn("__n", F.row_number().over(W.partitionBy(key).orderBy(*order))).filter(F.col("__n") <= most).drop("__n")
    chosen = settled(ranked.observe(left, F.count(F.lit(1)).alias("n")))
    a, b = seen.get["n"], left.get["n"]
    return chosen, rows.sparkSession.createDataFrame([(a, b, a - b)], "seen long, kept long, dropped long")


def alias_lookup(left: DataFrame, right: DataFrame, left_names: str, right_names: str, order: str) -> DataFrame:
    """left with the right row, the last in order, that shares any of its names: arrays of names on both sides, compared by their keys. Equi-joins on single names."""
    from supplymesh.functions.names import compact_key

    keyed = lambda c: F.explode(F.array_distinct(F.filter(F.transform(c, compact_key), lambda k: k != "")))
    known = right.select(keyed(right_names).alias("__k"), F.struct(*right.columns).alias("__row"), F.col(order).alias("__o"))
    best = known.groupBy("__k").agg(F.max_by(F.struct("__row", "__o"), "__o").alias("__best"))
    sets = left.select(F.col(left_names).alias("__names")).distinct()  # rows with the same names have the same match, and need no number of their own
    pairs = sets.select("__names", keyed("__names").alias("__k")).join(best, "__k")
    match = pairs.groupBy("__names").agg(F.max_by("__best.__row", "__best.__o").alias("match"))
    return left.join(match, F.col(left_names).eqNullSafe(F.col("__names")), "left").drop("__names")
