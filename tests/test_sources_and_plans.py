"""Sources, discovery, retrieval, streaming and the whole analysis."""

import datetime

import pytest
from pyspark.sql import functions as F

from supplymesh.operators import discovery, graph, retrieval, suppliers
from supplymesh.operators.resolve import Identities
from supplymesh.plans import analysis, bindings, control, rule_bindings, scale_bindings  # noqa: F401  (the last two add to bindings)
from supplymesh.sources import tables
from supplymesh.streaming import risk_feed

EVIDENCE = "array<struct<title:string,link:string,snippet:string>>"


@pytest.fixture(scope="module")
def identities(spark):
    return Identities(spark)


def test_profile_pages(spark):
    page = """<table class="infobox"><tr><th>Industry</th><td>Chips<sup>[1]</sup></td></tr><tr><th>Headquarters</th><td>Hsinchu,<br>Taiwan</td></tr></table>
    <p>Short.</p><p>A company that makes chips for other companies, and has done so for a very long time.<sup>[2]</sup></p>"""
    got = tables.profiles_of_pages(spark.createDataFrame([(page,), (None,)], "html string")).select("profile.*").collect()
    assert (got[0].industry, got[0].headquarters, got[0].website) == ("Chips", "Hsinchu, Taiwan", None) and got[0].description.endswith("long time.")
    assert got[1].industry == "Not found"
    fits = spark.createDataFrame([("TSMC", "Taiwan Semiconductor Manufacturing Company"), ("Apple", "Pear")], "c string, t string").select(tables.title_fits(F.col("t"), F.col("c")).alias("x")).collect()
    assert [r.x for r in fits] == [True, False]


def test_profiles_and_history_round_trip(spark, tmp_path):
    p = spark.createDataFrame([("Acme, Inc.", "x", "y", "z", None)], tables.PROFILE)
    tables.write_profiles(p, f"{tmp_path}/profiles")
    assert tables.profile_path("d", "Acme, Inc.") == "d/acme_inc_info.json"
    run = spark.createDataFrame([("acme", "2026-01-01T00:00:00", None, 75.0, "Good", 2, 1, ["A"])], tables.HISTORY)
    for _ in range(2):
        tables.append_history(run, f"{tmp_path}/history")
    assert [r.mode for r in tables.read_history(spark, f"{tmp_path}/history").collect()] == ["llm", "llm"]
    assert "acme" in tables.lookup_json(run, "company", "ACME").first().json


def test_feeds(spark):
    rss = "<rss><channel><item><title>A</title><description>d</description><link>l</link><pubDate>Fri, 13 Jun 2025 10:00:00 GMT</pubDate></item><item><title>A</title><description>e</description><link>m</link><pubDate>x</pubDate></item><item><title>B</title><description>f</description><link>n</link><pubDate>y</pubDate></item></channel></rss>"
    got = tables.feed_items(spark.createDataFrame([("S", "news", 0, rss), ("S", "news", 1, rss)], "supplier_name string, feed string, seq int, payload string")).orderBy("item").collect()
    assert [(r.title, r.snippet, r.item) for r in got] == [("A", "d", 0), ("B", "f", 1)]


def test_layers(spark):
    shape = "company string, name string"
    companies = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "company string")
    curated, v7, v6 = spark.createDataFrame([("a", "cur")], shape), spark.createDataFrame([("b", "new")], shape), spark.createDataFrame([("c", "old"), ("d", "old")], shape)
    live = spark.createDataFrame([(x, "live") for x in "abcd"], shape)
    there = [spark.createDataFrame([("b",), ("c",)], "company string"), spark.createDataFrame([("c",), ("d",)], "company string")]
    run = lambda **how: {r.company: r.name for r in discovery.layered(companies, curated, [v7, v6], live, there, discovery.Layers(**how)).collect()}
    assert run() == {"a": "cur", "b": "new", "c": "live", "d": "old"}  # c's newest file is empty: older ones don't count
    assert run(refresh=True) == run(cache=False) == dict.fromkeys("abcd", "live")
    assert run(cache_only=True) == {"a": "cur"}


def test_queries(spark):
    got = discovery.queries(spark.createDataFrame([("Qualcomm",), ("Acme",)], "company string"))
    own = [r.query for r in got.filter("company = 'Qualcomm'").orderBy("seq").collect()]
    assert own[0] == "Qualcomm foundry supplier" and len(own) == len({q.lower() for q in own}) == 17
    assert got.filter("company = 'Acme'").count() == 11


def test_extraction(spark, identities):
    hits = [("Qualcomm", 0, "TSMC", "TSMC serves as the main supplier for Nvidia, Apple, Broadcom, and Qualcomm.", "l1"), ("Qualcomm", 1, "ASE Technology", "ASE Technology provides outsourced semiconductor assembly and test services to Qualcomm.", "l2"), ("Qualcomm", 2, "Silicon Valley", "A valley with Qualcomm supplier offices.", "l3")]
    got = discovery.extract_candidates(spark.createDataFrame(hits, "company string, seq int, title string, snippet string, link string"), identities).collect()
    best = {r.name: r for r in got}
    assert best["TSMC"].tier == 1 and "ASE Technology" in best and not any("Valley" in n for n in best)


def test_merging(spark, identities):
    rows = [(i, n, loc, [p], 1, "Low", c, c, "T", ["T", n], [("t", link, "same")]) for i, (n, loc, p, c, link) in enumerate([("Foxconn", "Unknown (Verified by Research)", "b", 0.8, "x"), ("Hon Hai Precision Industry", "Taiwan", "a", 0.9, "y"), ("Hon Hai Technology Group", "China", "a", 0.7, "x")])]
    df = spark.createDataFrame(rows, f"seq long, name string, location string, products array<string>, tier int, criticality string, discovery_confidence double, propagated_confidence double, parent string, path array<string>, evidence {EVIDENCE}")
    r = suppliers.merged(identities.resolve(df, "name", "canonical"), identities).collect()
    assert len(r) == 1 and (r[0].canonical, r[0].name, r[0].location, r[0].products, r[0].criticality, r[0].discovery_confidence) == ("Hon Hai Precision Industry Co., Ltd.", "Hon Hai Precision Industry", "Taiwan", ["a", "b"], "Medium", 0.9)
    assert [e.link for e in r[0].evidence] == ["x", "y"] and r[0].path == ["T -> Foxconn", "T -> Hon Hai Precision Industry", "T -> Hon Hai Technology Group"]


def test_retrieval(spark):
    s = spark.createDataFrame([("Broadcom", [])], f"name string, evidence {EVIDENCE}")
    index = retrieval.embedded(spark.createDataFrame([(1, "Retrieved evidence: Broadcom supplies networking chips to Dell.")], "doc_id long, content string"))
    r = retrieval.enrich(s, index).first()
    assert r.rag_count == 1 and r.evidence[0].link.startswith("rag://")


def test_streaming(spark, tmp_path):
    at = datetime.datetime(2026, 1, 1)
    rows = [("TestCorp", "TestCorp", [], "TestCorp factory explosion", "An explosion at TestCorp.", at), ("TestCorp", "TestCorp", [], "TestCorp factory explosion", "An explosion at TestCorp.", at), ("TestCorp", "TestCorp", [], "Weather", "Nothing.", at)]
    shape = "supplier_name string, canonical string, aliases array<string>, title string, snippet string, published timestamp"
    spark.createDataFrame(rows, shape).write.parquet(f"{tmp_path}/in")
    stream = risk_feed.news_risks(spark.readStream.schema(shape).parquet(f"{tmp_path}/in"))
    q = stream.writeStream.format("memory").queryName("risks").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [r.severity for r in spark.table("risks").collect()] == ["Critical"]


def test_whole_analysis(spark):
    e = spark.createDataFrame([("Acme", 0, "TSMC", "Hsinchu, Taiwan", ["Semiconductor foundry"], 0.95, "High", [("t", "https://x.org", "TSMC supplies chips to Acme and is a foundry for Acme. TSMC manufactures chips for Acme.")]), ("TSMC", 1, "ASML", "Netherlands", ["Equipment"], 0.9, "High", [("t", "https://y.org", "ASML supplies equipment to TSMC as a component supplier. ASML is a vendor.")]), ("Acme", 2, "Low", "x", ["y"], 0.5, "Low", [])], f"source string, seq long, name string, location string, products array<string>, confidence double, criticality string, evidence {EVIDENCE}")
    news = spark.createDataFrame([("TSMC", "news", 0, "TSMC factory fire", "A fire at TSMC.", "Fri, 13 Jun 2025 10:00:00 GMT"), ("TSMC", "news", 1, "TSMC old strike", "TSMC strike.", "Fri, 13 Jun 2014 10:00:00 GMT")], analysis.NEWS)
    t = analysis.analyse(spark, "Acme", e, news, config=analysis.Config(limits=graph.Limits(max_depth=2), as_of="2025-07-01 00:00:00"))
    assert sorted((r.name, r.tier) for r in t["suppliers"].collect()) == [("ASML", 2), ("TSMC", 1)]
    assert {r.relationship_type for r in t["relationships"].collect()} == {"supplier", "upstream_supplier"}
    assert all(r.verified for r in t["verifications"].collect())
    assert sorted((r.supplier_name, r.risk_type, r.severity) for r in t["risks"].collect()) == [("TSMC", "Geopolitical", "High"), ("TSMC", "News", "High")]
    h = t["health"].first()
    assert h.supplier_count == 2 and 0 < h.overall_score <= 100
    lines = [r.line for r in t["report"].collect()]
    assert lines[0].startswith("Score") and any(x.startswith("TSMC: ") for x in lines)
    assert t["edges"].count() == 2 and t["tiers"].filter("source <> 'Acme'").count() == 1


def test_analysis_from_hits_profiles_and_plug_ins(spark):
    hits = [("Qualcomm", 0, "TSMC", "TSMC serves as the main supplier for Nvidia, Apple, Broadcom, and Qualcomm. TSMC manufactures chips for Qualcomm.", "http://l1"), ("Qualcomm", 1, "Foo Devices Inc", "Foo Devices Inc supplies semiconductor components to Qualcomm and is a supplier for Qualcomm.", "http://l2")]
    none = f"source string, seq long, name string, location string, products array<string>, confidence double, criticality string, evidence {EVIDENCE}"
    inputs = analysis.Inputs(edges=spark.createDataFrame([], none), hits=spark.createDataFrame(hits, "company string, seq int, title string, snippet string, link string"), profiles=spark.createDataFrame([("foo devices, inc", "Chips", None)], "name string, industry string, website string"))
    extra = spark.createDataFrame([("TSMC", "TSMC", 9, "Other", "Low", 0.5, "made up", "wait")], "supplier_name string, canonical string, seq long, risk_type string, severity string, confidence double, reasoning string, mitigation string")
    judged = lambda rows: rows.filter("name like 'Foo%'").select("seq", F.lit("supplier").alias("relationship_type"), F.lit(0.99).alias("confidence_score"), F.lit("model").alias("reasoning"))
    stages = control.Stages(spark, limit=600.0)
    t = analysis.analyse(spark, "Qualcomm", config=analysis.Config(limits=graph.Limits(max_depth=1)), inputs=inputs, classifier=judged, risk_providers=[lambda _: extra], stages=stages)
    names = {r.name for r in t["suppliers"].collect()}
    assert names == {"TSMC", "Foo Devices Inc"} or {"TSMC", "Foo Devices"} == names
    foo = [r for r in t["relationships"].collect() if r.canonical.startswith("Foo")]
    assert [(r.relationship_type, r.confidence_score, r.reasoning) for r in foo] == [("supplier", 0.99, "model")]
    assert [r.company_exists for r in t["verifications"].collect() if r.canonical.startswith("Foo")] == [True]
    assert t["risks"].filter("risk_type = 'Other'").count() == 1
    assert {r.stage for r in t["timings"].collect()} == {"supplier_discovery", "relationship_analysis", "verification", "risk_analysis", "total"}


def test_gates_follow_the_tier_and_rivals_need_evidence(spark, identities):
    shape = f"source string, seq long, name string, location string, products array<string>, confidence double, criticality string, evidence {EVIDENCE}"
    said = lambda x: [("t", "https://x.org", x)]
    rows = [
        ("TSMC", 0, "ASML", "x", [], 0.95, "High", said("ASML supplies EUV lithography systems to TSMC for advanced semiconductor manufacturing.")), ("TSMC", 1, "Broadcom", "x", [], 0.95, "High", said("TSMC and Broadcom have a long-running partnership.")),
        ("AMD", 2, "Intel", "x", [], 0.95, "High", said("Intel is a supplier, competes with AMD.")), ("AMD", 3, "Silicon Valley", "x", [], 0.95, "High", said("Silicon Valley is a supplier to AMD.")),
    ]
    got = analysis.gated_edges(spark.createDataFrame(rows, shape), identities, "Advanced Micro Devices").collect()
    assert {r.gate_tier for r in got if r.canonical == "ASML"} >= {1, 2, 3}
    assert not any(r.gate_tier > 1 for r in got if r.canonical == "Broadcom") and not any("Valley" in r.name for r in got)


def test_queries_and_sql_have_the_same_names():
    assert set(bindings.QUERIES) - set(bindings.ORACLES) == {"fuzzy_residue", "infobox_parse", "closest_names"}


def test_listed_titles_end_words_as_sql_does(spark, tmp_path):
    """A word ends before a letter that isn't ASCII, in SQL; German, French and Spanish titles have such ("Inüber")."""
    titles = ["Inüber", "IN", "The\u0301 x", "Ofñ", "in_x", "In7", "Inch", "the x", " The", "Of²", None]
    pages = [(i, "u", None if t is None else f'<html lang="de"><title>{t}</title>') for i, t in enumerate(titles)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: (r.title, r.lang, r.listed) for r in bindings.title_extract(spark, str(tmp_path)).collect()}
    listed = [True, True, True, True, False, False, False, True, False, True, None]
    assert got == {i: (t, None if t is None else "de", x) for i, (t, x) in enumerate(zip(titles, listed))}
