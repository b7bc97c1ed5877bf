"""Generic operators on small tables."""

import pytest
from pyspark.sql import functions as F

from supplymesh.operators import graph, relational, suppliers, vector


def edges(spark, rows):
    return spark.createDataFrame([(s, n, c, i) for i, (s, n, c) in enumerate(rows)], "source string, name string, confidence double, seq long")


def test_three_tiers(spark):
    e = edges(spark, [("Apple", "TSMC", 0.9), ("TSMC", "ASML", 0.95), ("ASML", "Zeiss", 0.85)])
    got = graph.expand_tiers(e, "Apple", graph.Limits(max_depth=3)).orderBy("seq").collect()
    assert [(r.name, r.tier, r.parent, r.propagated) for r in got] == [("TSMC", 1, "Apple", 0.9), ("ASML", 2, "TSMC", 0.86), ("Zeiss", 3, "ASML", 0.73)]
    assert got[2].path == ["Apple", "TSMC", "ASML", "Zeiss"]


F2B = [("R", "A", 0.95), ("R", "B", 0.9), ("A", "X", 0.95), ("A", "Y", 0.9), ("B", "X", 0.95), ("B", "Y", 0.9), ("B", "Z", 0.85), ("B", "W", 0.8)]


def test_visited_names_go_before_the_cut(spark):
    limits = graph.Limits(max_depth=2, per_parent=2)
    exact = graph.expand_tiers(edges(spark, F2B), "R", limits).orderBy("seq").collect()
    assert [r.name for r in exact] == ["A", "B", "X", "Y", "Z", "W"]
    parallel = graph.expand_tiers(edges(spark, F2B), "R", limits, mode="parallel").orderBy("seq").collect()
    assert [(r.name, r.parent) for r in parallel] == [("A", "R"), ("B", "R"), ("X", "A"), ("Y", "A")]


def test_limits_cycles_and_shared_names(spark):
    many = edges(spark, [("R", f"S{i}", 0.8 + i / 100) for i in range(7)])
    assert [r.name for r in graph.expand_tiers(many, "R").orderBy("seq").collect()] == ["S6", "S5", "S4", "S3", "S2"]
    loop = edges(spark, [("R", "A", 0.9), ("A", "B", 0.9), ("B", "A", 0.9), ("B", "R", 0.9), ("A", "A", 0.9), ("R", "C", 0.8), ("C", "B", 0.9)])
    got = graph.expand_tiers(loop, "R", graph.Limits(max_depth=5)).orderBy("seq").collect()
    assert [(r.name, r.parent) for r in got] == [("A", "R"), ("C", "R"), ("B", "A")]
    assert [r.tier for r in graph.expand_tiers(loop, "R", graph.Limits(max_depth=0)).collect()] == [1, 1]
    assert graph.expand_tiers(loop, "R", graph.Limits(max_depth=3, total=1)).count() == 2
    assert graph.expand_tiers(loop, "nobody").count() == 0
    deep = graph.expand_tiers(loop, "R", graph.Limits(max_depth=5, per_parent=None), mode="parallel").collect()
    assert sorted(r.name for r in deep) == ["A", "B", "C"]
    with pytest.raises(ValueError):
        graph.expand_tiers(loop, "R", mode="other")


def test_star_graph(spark):
    nodes, links = graph.star_graph(spark.createDataFrame([("A", "upstream_supplier"), ("B", None)], "name string, relationship string"), "R")
    assert (nodes.count(), sorted(map(tuple, links.collect()))) == (3, [("R", "A", "upstream_supplier"), ("R", "B", "supplier")])
    nodes, links = graph.star_graph(spark.createDataFrame([], "name string"), "R")
    assert (nodes.count(), links.count()) == (1, 0)


def test_two_key_join_and_last_writer(spark):
    left = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "z"), (None, None)], "n string, c string")
    right = spark.createDataFrame([("a", "q", 1, 10), ("y", "y", 2, 20), ("a", "r", 3, 30)], "n1 string, n2 string, o int, v int")
    got = {r.n: r.v for r in relational.two_key_left_join(left, right, ("n", "c"), ("n1", "n2"), "o", ["v"]).collect()}
    assert got == {"a": 30, "b": 20, "c": None, None: None}


def test_semi_join_if_any(spark):
    left = spark.createDataFrame([(1,), (2,)], "k int")
    assert [r.k for r in relational.semi_if_any(left, spark.createDataFrame([(2,), (2,)], "k int"), "k").collect()] == [2]
    assert relational.semi_if_any(left, spark.createDataFrame([], "k int"), "k").count() == 2


def test_deltas_and_best_rows(spark):
    runs = spark.createDataFrame([("c", 1, 75.0, 2, 1), ("c", 2, 80.0, 3, 0)], "company string, t int, health double, suppliers int, risks int")
    got = relational.delta_from_previous(runs, ["company"], ["t"], ["health", "suppliers", "risks"]).orderBy("t").collect()
    assert [(r.health_delta, r.suppliers_delta, r.risks_delta) for r in got] == [(0, 0, 0), (5.0, 1, -1)]
    rows = spark.createDataFrame([("k", 1, 0.5), ("k", 2, 0.9), ("k", 3, 0.9), ("n", 4, None)], "k string, seq int, s double")
    assert sorted(r.seq for r in relational.best_per_key(rows, ["k"], "s", ["seq"]).collect()) == [2, 4]


def test_set_metrics(spark):
    f = spark.createDataFrame([("c", "a"), ("c", "b"), ("c", "b"), ("d", "z")], "k string, i string")
    e = spark.createDataFrame([("c", "b"), ("c", "q"), ("e", "y")], "k string, i string")
    got = {r.k: tuple(r)[1:] for r in relational.set_metrics(f, e, "k", "i").collect()}
    assert got == {"c": (2, 2, 1, 1, 1), "d": (1, 0, 0, 0, 1), "e": (0, 1, 0, 1, 0)}
    assert suppliers.evaluation(f.withColumnsRenamed({"k": "company", "i": "canonical"}), e.withColumnsRenamed({"k": "company", "i": "canonical"})).filter("company = 'c'").first().precision == 0.5


def test_verification_quality_and_coverage(spark):
    s = spark.createDataFrame([("A", 1), ("B", 1), ("C", 2)], "canonical string, tier int")
    results = spark.createDataFrame([("A", 0, False), ("A", 1, True), ("B", 2, False)], "canonical string, seq long, verified boolean")
    q = suppliers.verification_quality(s, results)
    assert tuple(q.first()) == (1, 1, 1, 3, 0.3333, 0.3333, "Low")
    none = suppliers.verification_quality(s, results.limit(0)).first()
    assert (none.quality_factor, none.label, none.total_count) == (1.0, "Unassessed", 3)
    empty = suppliers.verification_quality(s.limit(0), results).first()
    assert (empty.quality_factor, empty.label, empty.total_count) == (1.0, "Insufficient Data", 0)
    c = suppliers.discovery_coverage(s, spark.createDataFrame([("A",), ("X",)], "canonical string"), suppliers.verification_quality(s, results.limit(0))).first()
    assert (c.matched_expected_count, c.coverage_ratio, c.precision, c.false_positive_rate, c.label) == (1, 0.5, 0.5, 0.5, "Medium")


def test_top_risks_keep_their_order_when_few(spark):
    rows = [("A", i, s) for i, s in enumerate(["Low", "Critical", "Medium"])] + [("B", i, s) for i, s in enumerate(["Low", "Medium", "High", "Critical"])]
    got = suppliers.top_risks(spark.createDataFrame(rows, "supplier_name string, seq int, severity string")).orderBy("supplier_name", "place").collect()
    assert [(r.supplier_name, r.severity) for r in got] == [("A", "Low"), ("A", "Critical"), ("A", "Medium"), ("B", "Critical"), ("B", "High"), ("B", "Medium")]


def test_similarity(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 1.0]), (4, [0.0, 0.0])], "vec_id int, embedding array<float>")
    got = vector.top_similar(v.filter("vec_id = 1"), v, 2).orderBy("rank").collect()
    assert [r.id for r in got] == [2, 3]
    with pytest.raises(ValueError):
        vector.top_similar(v, v, 1, most_queries=2)


def test_similarity_of_many_queries(spark, monkeypatch):
    v = spark.createDataFrame([(-1, [1.0, 0.0]), (-2, [0.6, 0.8]), (-3, [0.0, 1.0])], "vec_id long, embedding array<float>")
    many = spark.range(10_050).select(F.col("id").alias("vec_id"), F.when(F.col("id") % 2 == 0, F.array(F.lit(1.0), F.lit(0.1))).otherwise(F.array(F.lit(0.1), F.lit(1.0))).cast("array<float>").alias("embedding"))
    got = {(r.query_id, r["rank"]): r.id for r in vector.top_similar(many, v, 2).collect()}
    assert got == {(i, k): (-k if i % 2 == 0 else k - 4) for i in range(10_050) for k in (1, 2)}
    few = many.limit(9).unionByName(many.limit(3)).unionByName(v)
    rows = lambda: sorted(tuple(r) for r in vector.top_similar(few, v, 3).collect())
    whole = rows()
    monkeypatch.setattr(vector, "BLOCK_QUERIES", 2)
    assert rows() == whole


def test_sole_sources(spark):
    got = {r.s: (r.products, r.sole_products) for r in relational.sole_sources(spark.createDataFrame([("a", "p"), ("b", "p"), ("b", "q")], "s string, p string"), "s", "p").collect()}
    assert got == {"a": (1, 0), "b": (2, 1)}
    assert relational.numbered(spark.createDataFrame([("a", 2), ("a", 1)], "k string, v int"), ["k"], ["v"]).filter(F.col("number") == 1).first().v == 1
