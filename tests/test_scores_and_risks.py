"""Scores and risks against golden inputs and results."""

import pytest
from pyspark.sql import functions as F

from supplymesh.functions import levels, risk, scoring
from supplymesh.functions.rounding import py_round


def test_supplier_confidence(spark):
    rows = [(0.92, 0.98, 0.85, True, None, 0.89), (0.5, 0.5, 0.4, False, None, 0.43), (0.8, 0.9, 0.9, True, "High", 0.81), (0.0, None, None, None, None, 0.47)]
    df = spark.createDataFrame(rows, "d double, r double, v double, ok boolean, w string, want double")
    for exact in (True, False):
        got = df.select("want", scoring.confidence(F.col("d"), F.col("r"), F.col("v"), F.col("ok"), F.col("w"), F.lit(1.0), F.lit(1.0), exact).alias("x")).collect()
        assert [g.x for g in got] == [g.want for g in got]
    assert df.select(scoring.confidence(F.col("d"), F.col("r"), F.col("v"), F.col("ok"), F.col("w"), F.lit(0.2), F.lit(0.45)).alias("x")).first().x == 0.45


def test_criticality(spark):
    rows = [("supplier", ["Semiconductor foundry", "A-series chips"], True, 1.0, 0.9, "Critical"), ("partner", ["Electronics assembly"], False, 0.9, 0.45, "Low"), (None, ["Logistics", "Office supplies"], True, None, 0.25, "Low")]
    df = spark.createDataFrame(rows, "k string, p array<string>, u boolean, v double, want double, level string")
    for r in df.withColumn("s", scoring.criticality(F.col("k"), F.col("p"), F.col("u"), F.col("v"))).withColumn("l", levels.criticality_level(F.col("s"))).collect():
        assert r.s == pytest.approx(r.want) and r.l == r.level


def test_health(spark):
    cases = [([(0.95, 0.9, None)], 95.5, "Excellent"), ([(0.25, 0.3, "Critical")], 20.5, "Critical"), ([(0.9, 0.8, None), (0.4, 0.2, "High")], 60.5, "Moderate")]
    for rows, want, status in cases:
        df = spark.createDataFrame(rows, "c double, k double, w string")
        r = df.agg(F.round(F.avg(scoring.health_part(F.col("c"), F.col("k"), F.col("w"))) * 100, 1).alias("h")).withColumn("s", levels.health_status(F.col("h"))).first()
        assert (r.h, r.s) == (want, status)


def news(spark, rows, target=None, **options):
    df = spark.createDataFrame(rows, "name string, title string, snippet string")
    df = df.withColumn("rel", risk.relevance(F.col("name"), F.col("name"), F.array().cast("array<string>"), F.col("title"), F.col("snippet")))
    df = df.withColumn("r", F.when(F.col("rel") >= risk.LEAST_RELEVANCE, risk.news_risk(F.col("name"), F.array("name"), F.col("title"), F.col("snippet"), **options)))
    return [(None if r.r is None else r.r.severity, None if r.r is None else list(r.r["keywords"])) for r in df.collect()]


def test_news(spark):
    got = news(spark, [
        ("TestCorp", "TestCorp factory explosion causes massive disruption", "A major explosion occurred at the TestCorp factory."), ("TestCorp", "TestCorp strike update", "Workers are on strike."), ("TestCorp", "TestCorp investigation launched", "Regulators are investigating."),
        ("TestCorp", "War tensions disrupt global shipping lanes", "TestCorp was mentioned once."), ("TestCorp", "TestCorp factory shutdown risk rises amid war escalation", "TestCorp said its main production facility could be affected."),
        ("Samsung", "Samsung factory fire causes production disruption", "A Samsung Electronics fab halted output after a fire."), ("TestCorp", "TestCorp warning", "TestCorp issued a warning."),
    ])
    assert [s for s, _ in got] == ["Critical", "High", "Medium", None, "Critical", "High", None]
    assert "war" in got[4][1] and got[6][1] == ["war"]  # "warning" has "war", which then gives no risk


def test_strict_labor_terms(spark):
    deal = [("TSMC", "TSMC strike deal with partner", "TSMC and its partner strike a deal.")]
    assert news(spark, deal)[0][0] is not None
    assert news(spark, deal, strict_labor=True)[0][0] is None
    assert "union strike" in news(spark, [("TSMC", "TSMC union strike halts work", "TSMC union strike.")], strict_labor=True)[0][1]


def test_financial_news(spark):
    rows = [
        ("FinCorp", "FinCorp files for bankruptcy protection", "Major financial collapse of FinCorp.", "Critical"), ("FinCorp", "FinCorp announces major layoffs amid revenue collapse", "Significant workforce reduction at FinCorp.", "High"),
        ("FinCorp", "FinCorp earnings miss", "FinCorp", "Medium"), ("FinCorp", "FinCorp sees weak demand", "FinCorp", "Low"), ("FinCorp", "FinCorp and default", "FinCorp", None),
    ]
    df = spark.createDataFrame(rows, "n string, t string, s string, want string")
    for r in df.withColumn("r", risk.financial_risk(F.col("n"), F.col("t"), F.col("s"))).collect():
        assert (r.r.severity if r.r else None) == r.want
    rel = spark.createDataFrame([("FinCorp", "Saks files for bankruptcy protection", "Analysts mentioned FinCorp once in a market roundup.")], "n string, t string, s string")
    assert rel.select(risk.relevance(F.col("n"), F.col("n"), F.array().cast("array<string>"), F.col("t"), F.col("s"))).first()[0] < risk.LEAST_RELEVANCE


def test_geography(spark):
    df = spark.createDataFrame([("Foxconn", "Hsinchu, Taiwan"), ("Russian Metals", "Moscow, Russia"), ("Nobody", "Unknown"), ("S", "South China Sea")], "n string, l string")
    got = [(r.g.severity, r.g.confidence) if r.g else None for r in df.select(risk.geopolitical_risk(F.col("n"), F.col("l"), F.lit("A -> B")).alias("g")).collect()]
    assert got == [("High", 0.9), ("Medium", 0.7), None, ("Medium", 0.9)]


def test_dates(spark):
    rows = [("Fri, 13 Jun 2025 10:00:00 GMT", True), ("Mon, 01 Jan 2024 10:00:00 +0900", False), ("garbage", False), (None, False)]
    df = spark.createDataFrame(rows, "d string, want boolean").withColumn("got", risk.recent(F.col("d"), F.lit("2025-08-01 00:00:00").cast("timestamp_ntz"), 90))
    assert all(r.got == r.want for r in df.collect())


def test_external(spark):
    rows = [("News", "x", True), ("Operational", "Active shutdown.", True), ("News", "failed verification of site", False), ("Other", "nothing", False)]
    df = spark.createDataFrame(rows, "t string, r string, want boolean").withColumn("got", risk.is_external(F.col("t"), F.col("r")))
    assert all(r.got == r.want for r in df.collect())


def test_exact_rounding(spark):
    df = spark.createDataFrame([(2.675,), (0.285,), (0.8050000000000002,)], "x double")
    assert [r[0] for r in df.select(py_round(F.col("x"), 2, exact=True)).collect()] == [2.67, 0.28, 0.81]
    assert df.select(py_round(F.col("x"), 2)).first()[0] == 2.68


def test_labels(spark):
    df = spark.createDataFrame([("High", "Medium", "Unassessed")], "a string, b string, c string")
    assert df.select(levels.lowest_label(F.col("a"), F.col("b"), F.col("c"))).first()[0] == "Medium"
    caps = spark.createDataFrame([(0.9,), (0.5,), (0.3,), (0.1,), (0.0,)], "x double").select(levels.coverage_cap(F.col("x"))).collect()
    assert [r[0] for r in caps] == [1.0, 0.78, 0.6, 0.45, 0.25]
