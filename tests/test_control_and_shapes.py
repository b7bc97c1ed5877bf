"""Run control, and the shape of plans."""

import time

from pyspark.sql import functions as F

from supplymesh.operators import relational
from supplymesh.plans import bindings, control


def plan(df):
    return df._jdf.queryExecution().toString()


def test_stages_time_out(spark):
    s = control.Stages(spark, limit=8.0)
    with s.stage("quick"):
        spark.range(10).count()
    with s.stage("slow"):
        spark.range(8).rdd.map(lambda x: time.sleep(90)).count()
    rows = {r.stage: r.timed_out for r in s.table().collect()}
    assert rows == {"quick": False, "slow": True, "total": False} and s.seconds["slow"] < 60


def test_budgets_and_providers(spark):
    rows = spark.createDataFrame([("a", i) for i in range(5)] + [("b", 1)], "k string, i int")
    kept, audit = control.within_budget(rows, ["i"], 2, "k")
    assert kept.count() == 3 and [tuple(r) for r in audit.collect()] == [("a", 3)]
    one = spark.createDataFrame([("S", "News", "High", "r"), ("S", "News", "High", "r")], "supplier_name string, risk_type string, severity string, reasoning string")
    assert control.all_risks(rows, [lambda _: one, lambda _: one]).count() == 2


def test_alias_lookup(spark):
    left = spark.createDataFrame([("x", ["T.S.M.C", "Taiwan Semi"]), ("y", ["Nobody"])], "id string, names array<string>")
    right = spark.createDataFrame([(["taiwan semi"], 1, "old"), (["t s m c"], 2, "new")], "known array<string>, seq int, v string")
    got = {r.id: r.match.v if r.match else None for r in control.alias_lookup(left, right, "names", "known", "seq").collect()}
    assert got == {"x": "new", "y": None}


def test_groups_are_limited_before_their_shuffle(spark):
    df = spark.range(1000).withColumn("k", F.col("id") % 7)
    assert "WindowGroupLimit" in plan(relational.topk_per_key(df, ["k"], ["id"], 3))


def test_filters_and_columns_reach_the_scan(spark):
    shown = plan(bindings.visited_anti_join(spark, "/root/testdata/sf0.001"))
    physical = shown.split("== Physical Plan ==")[1]
    assert "EqualTo(o_orderpriority,1-URGENT" in physical and "o_totalprice" not in physical and "c_mktsegment" not in physical


#: Queries whose operators compare or split in Arrow batches, or run jobs before they return.
IN_ARROW = {"bfs_tiers", "resolve_names", "topk_similar", "tier_choice", "passage_mentions", "claimed_directions", "order_before_event", "observed_budget_lines", "layered_pages", "evidence_signals", "gate_without_names", "evidence_quality", "infobox_profiles"}


def test_column_queries_run_no_python(spark):
    for name, query in bindings.QUERIES.items():
        if name in bindings.ORACLES and name not in IN_ARROW:
            assert not any(x in plan(query(spark, "/root/testdata/sf0.001")) for x in ("ArrowEvalPython", "MapInArrow", "BatchEvalPython", "CartesianProduct")), name
