"""Names, identities and evidence against golden inputs and results."""

import pytest
from pyspark.sql import functions as F

from supplymesh.functions import candidates, evidence, names
from supplymesh.operators.resolve import Identities

EVIDENCE = "array<struct<title:string,link:string,snippet:string>>"


@pytest.fixture(scope="module")
def identities(spark):
    return Identities(spark)


def checked(spark, identities, rows, target=False):
    df = spark.createDataFrame(rows, "raw string, target string").withColumn("name", candidates.candidate_name(F.col("raw")))
    df = identities.resolve(df, "name", fuzzy=False).withColumn("known", identities.is_known(F.col("name"), F.col("canonical")))
    df = identities.with_variants(identities.resolve(df, "target", "target_canonical", fuzzy=False), "target_canonical", "tv")
    variants = F.concat(F.array(F.lower("target")), F.coalesce("tv", F.array().cast("array<string>")))
    why = candidates.rejection(F.col("name"), F.col("known"), F.when(F.col("target").isNotNull(), variants))
    return {r.raw: (None if r.why else r.name) for r in df.withColumn("why", why).collect()}


def test_candidate_names(spark, identities):
    wanted = {
        "Micron became a major supplier to Apple Inc": "Micron", "Fabless manufacturing including Apple Inc": "Apple Inc", "Raytheon is a business unit of RTX Corporation": "Raytheon",
        "International with Magna Electronics Corporation": "Magna Electronics Corporation", "Fabless manufacturing": None, "became a supplier to": None, "including": None, "supplier to": None, "company": None, "ThinkPad": None,
        "Intel Intel Corporation": "Intel Corporation", "IDEX Corporation IDEX Corporation": "IDEX Corporation", "Company Company Limited": None, "Corporation Corporation": None, "Inc Inc": None,
    }
    got = checked(spark, identities, [(k, None) for k in wanted])
    assert got == wanted
    assert checked(spark, identities, [("Fabless manufacturing including Apple Inc", "Apple")]) == {"Fabless manufacturing including Apple Inc": None}


def test_places_are_rejected(spark, identities):
    places = ["Silicon Wadi", "Silicon Valley", "technology hub", "Industrial Park", "Economic Zone", "innovation district", "region", "cluster", "Hsinchu Science Park"]
    good = ["Broadcom", "Compal Electronics", "Marvell Technology"]
    got = checked(spark, identities, [(x, "Dell") for x in places + good])
    assert [k for k, v in got.items() if v] == good
    df = spark.createDataFrame([(p,) for p in places], "n string")
    assert all(r[0] for r in df.select(candidates.is_place(F.col("n"))).collect())


def test_resolution(spark, identities):
    wanted = {
        "Foxconn": "Hon Hai Precision Industry Co., Ltd.", "Hon Hai Precision Industry": "Hon Hai Precision Industry Co., Ltd.", "Hon Hai Technology Group": "Hon Hai Precision Industry Co., Ltd.", "Pegatron": "Pegatron Corporation",
        "Sony Semiconductor": "Sony Semiconductor Solutions", "tsmc": "Taiwan Semiconductor Manufacturing Company", "T.S.M.C.": "Taiwan Semiconductor Manufacturing Company", "Qualcom Inc": "Qualcomm", "Nobody Ltd": "Nobody Ltd", "": "",
    }
    df = identities.resolve(spark.createDataFrame([(k,) for k in wanted], "name string"), "name")
    got = {r.name: r.canonical for r in df.collect()}
    assert got == wanted
    again = identities.resolve(df.select(F.col("canonical").alias("name")), "name").filter("name <> canonical")
    assert again.count() == 0  # resolving is idempotent here


def test_names(spark):
    df = spark.createDataFrame([("Acme  Acme Holdings Inc.", "ACME-Corp., Ltd"), ("Taiwan Semiconductor Manufacturing Company", None)], "a string, b string")
    r = df.select(names.normalize_name(F.col("a")).alias("n"), names.compact_key(F.col("b")).alias("k"), names.initials(F.col("a")).alias("i")).collect()
    assert (r[0].n, r[0].k) == ("Acme Holdings", "acme corp ltd")
    assert (r[1].i, r[1].k) == ("TSMC", "")


def gated(spark, identities, tier, confidence, texts, candidate=None, source=None):
    items = [("", "", t) for t in texts]
    df = spark.createDataFrame([(items, candidate or "x", source or "x")], f"e {EVIDENCE}, c string, s string")
    for name, out in (("c", "cv"), ("s", "sv")):
        df = identities.with_variants(identities.resolve(df, name, f"{name}c"), f"{name}c", out)
    g = evidence.gate(F.col("e"), F.lit(tier), F.lit(confidence), F.col("c"), F.col("cv") if candidate else None, F.col("sv") if source else None)
    return tuple(df.select(g.alias("g")).first().g)


def test_evidence_gate(spark, identities):
    ok, why = gated(spark, identities, 3, 0.92, ["RTX Corporation is a competitor and industry peer in aerospace.", "Raytheon was acquired in a separate context and is an industry peer."])
    assert not ok and "Tier-3" in why
    assert gated(spark, identities, 3, 0.93, ["TSMC manufactures chips for Apple under a supply agreement.", "Apple sources advanced semiconductors from TSMC."])[0]
    ok, why = gated(spark, identities, 2, 0.88, ["A long-running partnership exists between the companies."])
    assert not ok and "Score:" in why
    assert gated(spark, identities, 2, 0.88, ["GlobalFoundries is part of TSMC's semiconductor ecosystem and appears in supply-chain report coverage for foundry manufacturing."], candidate="GlobalFoundries")[0]
    assert gated(spark, identities, 2, 0.95, ["ASML supplies EUV lithography systems to TSMC for advanced semiconductor manufacturing."], "ASML", "TSMC")[0]
    assert not gated(spark, identities, 2, 0.95, ["TSMC and ASML were both mentioned in a supplier list."], "ASML", "TSMC")[0]
    assert gated(spark, identities, 1, 0.8, [])[0] and not gated(spark, identities, 1, 0.7, [])[0] and not gated(spark, identities, 2, 0.9, [])[0]
    assert not gated(spark, identities, 2, 0.9, ["TSMC supplies chips to Apple, a supplier said."], "Apple", "TSMC")[0]


def test_classifier(spark):
    rows = [
        ("Apple", "TSMC", "TSMC manufactures chips for Apple as a foundry for Apple and its supplier.", False), ("Apple", "ThinkPad", "ThinkPad laptop", False), ("Apple", "Beats", "Beats is a subsidiary of Apple", False),
        ("Intel", "Dell", "Intel supplies processors", False), ("AMD", "Intel", "Nothing", True), ("Apple", "X", "They are a strategic partner", False), ("Apple", "Y", "Nothing here", False),
    ]
    df = spark.createDataFrame(rows, "t string, c string, x string, k boolean").withColumn("r", evidence.classify(F.col("t"), F.col("c"), F.col("x"), F.col("k")))
    got = [tuple(r.r)[:2] for r in df.collect()]
    assert [k for k, _ in got] == ["supplier", "product_or_brand", "unrelated", "customer", "competitor", "partner", "unrelated"]
    assert [s for _, s in got][1:] == [0.9, 0.82, 0.78, 0.75, 0.58, 0.35] and 0.8 <= got[0][1] <= 0.95
    kept = df.select(evidence.enforce(F.col("r"), F.col("x"), F.lit(2)).alias("e")).collect()
    assert kept[0].e.relationship_type == "upstream_supplier" and kept[5].e.relationship_type == "unrelated"


def test_evidence_and_source_quality(spark):
    items = [("", "https://en.wikipedia.org/wiki/X", "X is a supplier"), ("", "curated://a/b", "It supplies chips"), ("", "ftp://z", "nothing")]
    r = spark.createDataFrame([(items,), ([],)], f"e {EVIDENCE}").select(evidence.evidence_quality(F.col("e")).alias("q"), evidence.source_quality(F.col("e")).alias("s")).collect()
    assert r[0].q == 1.0 and r[0].s == pytest.approx(0.72) and (r[1].q, r[1].s) == (0.0, 0.0)
