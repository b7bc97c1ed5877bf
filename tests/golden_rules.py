"""The library's rules on small tables, each with the rows that it must give: cases for test_golden_rules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from supplymesh.functions import candidates, evidence, levels, names, risk, scoring
from supplymesh.operators import discovery, graph, relational, suppliers
from supplymesh.operators.resolve import Identities
from supplymesh.plans import control
from supplymesh.sources import tables

EVIDENCE = "array<struct<title:string,link:string,snippet:string>>"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ROWS: dict[str, tuple[list[str], tuple]] = {}


def gives(columns: str, *rows: tuple):
    """Registers a case under its function's name; rows are what it gives in these columns (name kind, ...)."""

    def take(query):
        QUERIES[query.__name__] = query
        ROWS[query.__name__] = [c.split()[0] for c in columns.split(", ")], rows
        return query

    return take


def _numbered(spark: SparkSession, rows: list[tuple], shape: str) -> DataFrame:
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"case int, {shape}")


def _with_variants(ids: Identities, df: DataFrame, name: str, out: str) -> DataFrame:
    return ids.with_variants(ids.resolve(df, name, f"{name}_c", fuzzy=False), f"{name}_c", out).drop(f"{name}_c")


# --- evidence ------------------------------------------------------------------------------------


@gives("case int, accepted boolean", (0, False), (1, True), (2, False), (3, True), (4, False))
def gate_without_names(spark, sf_dir):
    """Evidence scores against the thresholds of tiers."""
    rows = [
        (3, 0.92, ["Borealis Wings is a rival of the firm.", "An investor acquired it last spring."]),
        (3, 0.93, ["Nordwafer manufactures dies for Quillon, says a supply agreement.", "Quillon sources wafers from Nordwafer."]),
        (2, 0.88, ["The two have worked together for years."]), (1, 0.8, []), (1, 0.7, []),
    ]
    df = _numbered(spark, [(t, c, [("", "", x) for x in xs]) for t, c, xs in rows], f"tier int, confidence double, e {EVIDENCE}")
    return df.select("case", evidence.gate(F.col("e"), F.col("tier"), F.col("confidence"))["accepted"].alias("accepted"))


@gives("case int, accepted boolean", (0, True), (1, True), (2, False), (3, False), (4, False))
def gate_with_direction(spark, sf_dir):
    """Evidence has to say who supplies whom."""
    rows = [
        ("GlobalFoundries", "TSMC", "Each month GlobalFoundries supplies parts to TSMC for a pilot line."), ("ASML", "TSMC", "ASML provides equipment to TSMC, as it has for long."),
        ("ASML", "TSMC", "One supplier list names ASML and then TSMC."), ("Apple", "TSMC", "As a supplier tells, TSMC supplies chips to Apple."), ("ASML", "TSMC", "Nothing about either."),
    ]
    ids = Identities(spark)
    df = _numbered(spark, [(c, s, [("", "", x)]) for c, s, x in rows], f"c string, s string, e {EVIDENCE}")
    df = _with_variants(ids, _with_variants(ids, df, "c", "cv"), "s", "sv")
    return df.select("case", evidence.gate(F.col("e"), F.lit(2), F.lit(0.95), F.col("c"), F.col("cv"), F.col("sv"))["accepted"].alias("accepted"))


_CLAIMS = [
    ("Apple", "ThinkPad", "ThinkPad laptop", False), ("Apple", "Beats", "Beats is a subsidiary of Apple", False), ("Intel", "Dell", "Intel supplies processors", False), ("AMD", "Intel", "Nothing", True),
    ("Apple", "X", "They are a strategic partner", False), ("Apple", "Y", "Nothing here", False), ("Apple", "TSMC", "TSMC is a supplier and foundry.", False),
]


@gives(
    "case int, kind string, score double",
    (0, "product_or_brand", 0.9), (1, "unrelated", 0.82), (2, "customer", 0.78), (3, "competitor", 0.75), (4, "partner", 0.58), (5, "unrelated", 0.35),
)
def classify_relationship(spark, sf_dir):
    df = _numbered(spark, _CLAIMS[:6], "t string, c string, x string, k boolean")
    return df.withColumn("r", evidence.classify(F.col("t"), F.col("c"), F.col("x"), F.col("k"))).select("case", F.col("r.relationship_type").alias("kind"), F.col("r.confidence_score").alias("score"))


@gives("case int, kind string", (0, "product_or_brand"), (1, "unrelated"), (2, "customer"), (3, "competitor"), (4, "unrelated"), (5, "unrelated"), (6, "upstream_supplier"))
def enforce_thresholds(spark, sf_dir):
    """Partners below the least confidence are unrelated; suppliers beyond the first tier are upstream."""
    df = _numbered(spark, _CLAIMS, "t string, c string, x string, k boolean").withColumn("r", evidence.classify(F.col("t"), F.col("c"), F.col("x"), F.col("k")))
    return df.select("case", evidence.enforce(F.col("r"), F.col("x"), F.lit(2))["relationship_type"].alias("kind"))


@gives("case int, quality double, source double", (0, 1.0, 0.72), (1, 0.0, 0.0))
def evidence_and_source_quality(spark, sf_dir):
    items = [("", "https://en.wikipedia.org/wiki/X", "X is a supplier"), ("", "curated://a/b", "It supplies chips"), ("", "ftp://z", "nothing")]
    return _numbered(spark, [(items,), ([],)], f"e {EVIDENCE}").select("case", evidence.evidence_quality(F.col("e")).alias("quality"), evidence.source_quality(F.col("e")).alias("source"))


# --- names ---------------------------------------------------------------------------------------

_RAW = {
    "Veltron became a major supplier to Quillon Inc": "Veltron", "Board manufacturing including Quillon Inc": "Quillon Inc", "Sondheim is a business unit of Ostra Corporation": "Sondheim", "Europe with Ferrum Electronics Corporation": "Ferrum Electronics Corporation",
    "Ostra Ostra Corporation": "Ostra Corporation", "Kelt Corporation Kelt Corporation": "Kelt Corporation", "Broadcom": "Broadcom", "Compal Electronics": "Compal Electronics", "Marvell Technology": "Marvell Technology",
    **dict.fromkeys(("Fabless manufacturing", "became a supplier to", "including", "supplier to", "company", "ThinkPad", "Company Company Limited", "Corporation Corporation", "Inc Inc", "Silicon Wadi", "Silicon Valley", "technology hub", "Industrial Park", "Hsinchu Science Park")),
}


@gives("raw string, name string", *_RAW.items())
def candidate_names(spark, sf_dir):
    """Organisations named in fragments; null where there is none."""
    ids = Identities(spark)
    df = spark.createDataFrame([(x,) for x in _RAW], "raw string").withColumn("name", candidates.candidate_name(F.col("raw")))
    df = ids.resolve(df, "name", fuzzy=False)
    why = candidates.rejection(F.col("name"), ids.is_known(F.col("name"), F.col("canonical")))
    return df.select("raw", F.when(why.isNull(), F.col("name")).alias("name"))


@gives("place string, found boolean", *((x, True) for x in ("Silicon Wadi", "Silicon Valley", "technology hub", "Industrial Park", "Economic Zone", "innovation district", "region", "cluster", "Hsinchu Science Park")), ("Broadcom", False), ("Compal Electronics", False))
def place_names(spark, sf_dir):
    rows = [(x,) for x in ("Silicon Wadi", "Silicon Valley", "technology hub", "Industrial Park", "Economic Zone", "innovation district", "region", "cluster", "Hsinchu Science Park", "Broadcom", "Compal Electronics")]
    return spark.createDataFrame(rows, "place string").select("place", candidates.is_place(F.col("place")).alias("found"))


@gives(
    "name string, reason string",
    ("Broadcom Inc", None), ("Acme Corporation", "Low confidence"), ("AB", "Too short"), ("Acme Corporation.", "Looks like a sentence fragment or title"), ("Partners", "Generic placeholder"), ("Silicon Valley", "location, region, or ecosystem label, not a supplier company"),
)
def supplier_names(spark, sf_dir):
    rows = [("Broadcom Inc", 0.9), ("Acme Corporation", 0.7), ("AB", 0.9), ("Acme Corporation.", 0.9), ("Partners", 0.9), ("Silicon Valley", 0.9)]
    df = spark.createDataFrame(rows, "name string, confidence double")
    return df.select("name", candidates.supplier_name_rejection(F.col("name"), F.col("confidence"), F.lit(False)).alias("reason"))


_RESOLVED = {
    "Foxconn": "Hon Hai Precision Industry Co., Ltd.", "Hon Hai Precision Industry": "Hon Hai Precision Industry Co., Ltd.", "Hon Hai Technology Group": "Hon Hai Precision Industry Co., Ltd.", "Pegatron": "Pegatron Corporation", "Sony Semiconductor": "Sony Semiconductor Solutions",
    "tsmc": "Taiwan Semiconductor Manufacturing Company", "T.S.M.C.": "Taiwan Semiconductor Manufacturing Company", "Qualcom Inc": "Qualcomm", "Nobody Ltd": "Nobody Ltd", "": "",
}


@gives("name string, canonical string", *_RESOLVED.items())
def resolve_identities(spark, sf_dir):
    """By key, without suffixes, by initials, by closeness, else the name itself."""
    return Identities(spark).resolve(spark.createDataFrame([(x,) for x in _RESOLVED], "name string"), "name")


@gives("name string, normalized string, initials string, slug string", ("Acme  Acme Holdings Inc.", "Acme Holdings", "AAHI", "acme_acme_holdings_inc"), ("Taiwan Semiconductor Manufacturing Company", "Taiwan Semiconductor Manufacturing Company", "TSMC", "taiwan_semiconductor_manufacturing_company"))
def name_forms(spark, sf_dir):
    n = F.col("name")
    return spark.createDataFrame([("Acme  Acme Holdings Inc.",), ("Taiwan Semiconductor Manufacturing Company",)], "name string").select("name", names.normalize_name(n).alias("normalized"), names.initials(n).alias("initials"), names.slug(n).alias("slug"))


# --- scores --------------------------------------------------------------------------------------


@gives("case int, confidence double", (0, 0.89), (1, 0.43), (2, 0.81), (3, 0.47))
def supplier_confidence(spark, sf_dir):
    df = _numbered(spark, [(0.92, 0.98, 0.85, True, None), (0.5, 0.5, 0.4, False, None), (0.8, 0.9, 0.9, True, "High"), (0.0, None, None, None, None)], "d double, r double, v double, ok boolean, w string")
    return df.select("case", scoring.confidence(F.col("d"), F.col("r"), F.col("v"), F.col("ok"), F.col("w"), F.lit(1.0), F.lit(1.0)).alias("confidence"))


@gives("case int, score double, level string", (0, 0.9, "Critical"), (1, 0.45, "Low"), (2, 0.25, "Low"))
def supplier_criticality(spark, sf_dir):
    df = _numbered(spark, [("supplier", ["Semiconductor foundry", "A-series chips"], True, 1.0), ("partner", ["Electronics assembly"], False, 0.9), (None, ["Logistics", "Office supplies"], True, None)], "k string, p array<string>, u boolean, v double")
    return df.withColumn("score", scoring.criticality(F.col("k"), F.col("p"), F.col("u"), F.col("v"))).select("case", "score", levels.criticality_level(F.col("score")).alias("level"))


@gives("case int, score double, suppliers long, status string", (0, 95.5, 1, "Excellent"), (1, 20.5, 1, "Critical"), (2, 60.5, 2, "Moderate"))
def chain_health(spark, sf_dir):
    cases = [[(0.95, 0.9, None, "Critical")], [(0.25, 0.3, "Critical", "Low")], [(0.9, 0.8, None, "High"), (0.4, 0.2, "High", "Low")]]
    out = None
    for i, rows in enumerate(cases):
        one = suppliers.health(spark.createDataFrame(rows, "final_confidence double, criticality_score double, worst string, criticality_level string"))
        one = one.select(F.lit(i).alias("case"), F.col("overall_score").alias("score"), F.col("supplier_count").alias("suppliers"), "status")
        out = one if out is None else out.unionByName(one)
    return out


@gives("case int, company_exists boolean, verified boolean, score double", (0, True, True, 0.93), (1, False, False, 0.35), (2, True, False, 0.45), (3, True, True, 0.84))
def verification_scores(spark, sf_dir):
    """Existence by knowledge, profile or website, then the relationship; what isn't both stays low."""
    rows = [
        (True, False, None, "supplier", 0.9, 1.0, 0.9), (False, False, None, "supplier", 0.9, 1.0, 0.9), (False, True, "Chips", "partner", 0.9, 0.4, 0.2), (False, True, "Chips", "supplier", 0.8, 0.9, 0.9),
    ]
    df = _numbered(spark, rows, "known boolean, found boolean, industry string, kind string, rel double, q double, s double")
    none = F.array().cast(EVIDENCE)
    exists = scoring.existence(F.col("known"), F.col("found"), F.col("industry"), F.lit(None).cast("string"), none)
    v = scoring.verification(exists, F.col("known"), F.col("kind"), F.col("rel"), F.col("q"), F.col("s"))
    return df.withColumn("v", v).select("case", "v.company_exists", "v.verified", F.round("v.confidence_score", 2).alias("score"))


@gives("snippet string, quality int", ("Acme is a company", 5), ("nothing at all", 0), ("Acme supplier and vendor", 9))
def search_hit_quality(spark, sf_dir):
    df = spark.createDataFrame([("Acme is a company",), ("nothing at all",), ("Acme supplier and vendor",)], "snippet string")
    return df.select("snippet", scoring.search_quality(F.lit("Acme"), F.col("snippet")).alias("quality"))


@gives("name string, industry string", ("Apple", "Devices"), ("Acme", "Unknown"), ("Other", "Chips"))
def industries(spark, sf_dir):
    df = spark.createDataFrame([("Apple", "Unknown"), ("Acme", "Unknown"), ("Other", "Chips")], "name string, industry string")
    return df.select("name", scoring.industry_fallback(F.col("name"), F.col("industry"), {"apple": "Devices"}).alias("industry"))


@gives("verified_count long, failed_count long, missing_count long, total_count long, quality_ratio double, quality_factor double, label string", (1, 1, 1, 3, 0.3333, 0.3333, "Low"), (0, 0, 0, 3, 1.0, 1.0, "Unassessed"), (0, 0, 0, 0, 0.0, 1.0, "Insufficient Data"))
def verification_counts(spark, sf_dir):
    """With a later result over an earlier one, without any result, without suppliers."""
    s = spark.createDataFrame([("A", 1), ("B", 1), ("C", 2)], "canonical string, tier int")
    results = spark.createDataFrame([("A", 0, False), ("A", 1, True), ("B", 2, False)], "canonical string, seq long, verified boolean")
    return suppliers.verification_quality(s, results).unionByName(suppliers.verification_quality(s, results.limit(0))).unionByName(suppliers.verification_quality(s.limit(0), results))


@gives("matched_expected_count long, coverage_ratio double, precision double, false_positive_rate double, label string", (1, 0.5, 0.5, 0.5, "Medium"))
def discovery_coverage(spark, sf_dir):
    s = spark.createDataFrame([("A", 1), ("B", 1), ("C", 2)], "canonical string, tier int")
    none = spark.createDataFrame([], "canonical string, seq long, verified boolean")
    got = suppliers.discovery_coverage(s, spark.createDataFrame([("A",), ("X",)], "canonical string"), suppliers.verification_quality(s, none))
    return got.select("matched_expected_count", "coverage_ratio", "precision", "false_positive_rate", "label")


@gives("company string, true_positives long, false_positives long, false_negatives long, precision double, recall double", ("c", 1, 1, 1, 0.5, 0.5), ("d", 2, 0, 0, 1.0, 1.0), ("Average", 3, 1, 1, 0.75, 0.75))
def benchmark_evaluation(spark, sf_dir):
    """Precision and recall by company, and their means."""
    shape = "company string, canonical string"
    found = spark.createDataFrame([("c", "a"), ("c", "b"), ("c", "b"), ("d", "x"), ("d", "y")], shape)
    return suppliers.evaluation(found, spark.createDataFrame([("c", "b"), ("c", "q"), ("d", "x"), ("d", "y")], shape), average=True)


# --- risks ---------------------------------------------------------------------------------------

_NEWS = [
    ("TestCorp", "Explosion at a TestCorp plant", "The blast hit the plant of TestCorp at night."), ("TestCorp", "TestCorp faces a strike", "Its workforce walked out."), ("TestCorp", "New investigation of TestCorp", "An office looks into prices."),
    ("TestCorp", "Shipping suffers from war", "TestCorp is named in passing."), ("TestCorp", "War nears the factory of TestCorp", "TestCorp fears for its largest site."),
    ("Samsung", "Fire in a Samsung fab", "Samsung stopped one line after the fire."), ("TestCorp", "A warning by TestCorp", "TestCorp told its owners of a warning."),
]


@gives("case int, relevant boolean, severity string", (0, True, "Critical"), (1, True, "High"), (2, True, "Medium"), (3, False, None), (4, True, "Critical"), (5, True, "High"), (6, True, None))
def news_risks(spark, sf_dir):
    df = _numbered(spark, _NEWS, "name string, title string, snippet string")
    relevant = risk.relevance(F.col("name"), F.col("name"), F.array().cast("array<string>"), F.col("title"), F.col("snippet")) >= risk.LEAST_RELEVANCE
    r = risk.news_risk(F.col("name"), F.array("name"), F.col("title"), F.col("snippet"))["severity"]
    return df.select("case", relevant.alias("relevant"), F.when(relevant, r).alias("severity"))


@gives("case int, severity string", (0, "Critical"), (1, "High"), (2, "Medium"), (3, "Low"), (4, None))
def financial_risks(spark, sf_dir):
    rows = [("FinCorp filed for bankruptcy", "The court named a trustee for FinCorp."), ("Revenue collapse at FinCorp", "FinCorp plans layoffs."), ("FinCorp earnings miss", "FinCorp"), ("FinCorp sees weak demand", "FinCorp"), ("FinCorp and default", "FinCorp")]
    return _numbered(spark, rows, "t string, s string").select("case", risk.financial_risk(F.lit("FinCorp"), F.col("t"), F.col("s"))["severity"].alias("severity"))


@gives("name string, severity string, confidence double", ("Foxconn", "High", 0.9), ("Russian Metals", "Medium", 0.7), ("Nobody", None, None), ("S", "Medium", 0.9))
def geopolitical_risks(spark, sf_dir):
    df = spark.createDataFrame([("Foxconn", "Hsinchu, Taiwan"), ("Russian Metals", "Moscow, Russia"), ("Nobody", "Unknown"), ("S", "South China Sea")], "name string, l string")
    g = risk.geopolitical_risk(F.col("name"), F.col("l"), F.lit("A -> B"))
    return df.select("name", g["severity"].alias("severity"), g["confidence"].alias("confidence"))


@gives("kind string, reason string, found boolean", ("News", "x", True), ("Operational", "Active shutdown.", True), ("News", "failed verification of site", False), ("Other", "nothing", False))
def external_risks(spark, sf_dir):
    df = spark.createDataFrame([("News", "x"), ("Operational", "Active shutdown."), ("News", "failed verification of site"), ("Other", "nothing")], "kind string, reason string")
    return df.select("kind", "reason", risk.is_external(F.col("kind"), F.col("reason")).alias("found"))


@gives("supplier_name string, severity string, place int", ("A", "Low", 1), ("A", "Critical", 2), ("A", "Medium", 3), ("B", "Critical", 1), ("B", "High", 2), ("B", "Medium", 3))
def top_risks(spark, sf_dir):
    rows = [("A", i, s) for i, s in enumerate(["Low", "Critical", "Medium"])] + [("B", i, s) for i, s in enumerate(["Low", "Medium", "High", "Critical"])]
    return suppliers.top_risks(spark.createDataFrame(rows, "supplier_name string, seq int, severity string")).select("supplier_name", "severity", "place")


@gives("raw string, published string", ("Fri, 13 Jun 2025 10:00:05 GMT", "2025-06-13 10:00:05"), ("Tue, 05 Mar 2024 10:00 GMT", "2024-03-05 10:00:00"), ("5 mar 24 9:30 +0900", "2024-03-05 09:30:00"), ("1 Jan 99 00:00:00", "1999-01-01 00:00:00"), ("garbage", None))
def published_dates(spark, sf_dir):
    df = spark.createDataFrame([(x,) for x in ("Fri, 13 Jun 2025 10:00:05 GMT", "Tue, 05 Mar 2024 10:00 GMT", "5 mar 24 9:30 +0900", "1 Jan 99 00:00:00", "garbage")], "raw string")
    return df.select("raw", F.date_format(risk.published(F.col("raw")), "yyyy-MM-dd HH:mm:ss").alias("published"))


# --- sources and discovery -----------------------------------------------------------------------


@gives("title string, snippet string, pub_date string, item int", ("A", "", "x", 0), ("B", "about B", None, 1), ("C & D", "plain", "Fri, 13 Jun 2025 10:00:00 GMT", 2))
def feed_items(spark, sf_dir):
    """Fields stay with their item; titles count once; what isn't XML gives nothing."""
    rss = "<rss><channel><title>feed</title><item><title>A</title><pubDate>x</pubDate></item><item><title>B</title><description>about B</description></item><item><title>A</title><description>again</description></item><item><description>no title</description></item><item><title>C &amp; D</title><description><![CDATA[plain]]></description><pubDate>Fri, 13 Jun 2025 10:00:00 GMT</pubDate></item></channel></rss>"
    rows = [("S", "news", 0, rss), ("S", "news", 1, "<rss><channel><item><title>cut"), ("S", "news", 2, "no xml"), ("S", "news", 3, None)]
    return tables.feed_items(spark.createDataFrame(rows, "supplier_name string, feed string, seq int, payload string")).select("title", "snippet", "pub_date", "item")


@gives("page int, industry string, headquarters string, website string", (0, "Chips", "Hsinchu, Taiwan", None), (1, "Not found", "Not found", None))
def infobox_profiles(spark, sf_dir):
    page = '<table class="infobox"><tr><th>Industry</th><td>Chips<sup>[1]</sup></td></tr><tr><th>Headquarters</th><td>Hsinchu,<br>Taiwan</td></tr></table><p>Short.</p>'
    df = spark.createDataFrame([(0, page), (1, None)], "page int, html string")
    return tables.profiles_of_pages(df).select("page", "profile.industry", "profile.headquarters", "profile.website")


@gives("company string, title string, fits boolean", ("TSMC", "Taiwan Semiconductor Manufacturing Company", True), ("Apple", "Pear", False), ("Apple Inc", "Apple", True))
def page_titles(spark, sf_dir):
    df = spark.createDataFrame([("TSMC", "Taiwan Semiconductor Manufacturing Company"), ("Apple", "Pear"), ("Apple Inc", "Apple")], "company string, title string")
    return df.select("company", "title", tables.title_fits(F.col("title"), F.col("company")).alias("fits"))


@gives("company string, name string, layer string", ("a", "cur", "curated"), ("b", "new", "cache 0"), ("c", "live", "live"), ("d", "old", "cache 1"))
def layered_sources(spark, sf_dir):
    """Curated rows, then caches from the newest on, then live ones; an empty newest cache hides older ones."""
    shape = "company string, name string"
    companies = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "company string")
    versions = [spark.createDataFrame([("b", "new")], shape), spark.createDataFrame([("c", "old"), ("d", "old")], shape)]
    there = [spark.createDataFrame([("b",), ("c",)], "company string"), spark.createDataFrame([("c",), ("d",)], "company string")]
    return discovery.layered(companies, spark.createDataFrame([("a", "cur")], shape), versions, spark.createDataFrame([(x, "live") for x in "abcd"], shape), there)


@gives("seq int, name string", (0, "Broadcom"))
def cached_rows(spark, sf_dir):
    """Rows of a cached list with usable names."""
    payload = '[{"name": "Broadcom"}, {"name": "Silicon Valley"}, {"location": "x"}]'
    return discovery.sanitised(spark.createDataFrame([(payload,), ("{}",), ("no json",)], "payload string"), "payload").select("seq", "name")


@gives("company string, queries long, first string", ("Qualcomm", 17, "Qualcomm foundry supplier"), ("Acme", 11, "Acme suppliers"))
def search_queries(spark, sf_dir):
    """Each company's own queries before the general ones, every one once."""
    got = discovery.queries(spark.createDataFrame([("Qualcomm",), ("Acme",)], "company string"))
    return got.groupBy("company").agg(F.count_distinct(F.lower("query")).alias("queries"), F.min_by("query", "seq").alias("first"))


@gives("name string, tier int", ("TSMC", 1), ("ASE Technology", 1))
def extracted_candidates(spark, sf_dir):
    hits = [("Qualcomm", 0, "TSMC", "TSMC is a foundry and supplier for Qualcomm.", "l1"), ("Qualcomm", 1, "ASE Technology", "ASE Technology provides services to Qualcomm, chip packaging above all.", "l2"), ("Qualcomm", 2, "Silicon Valley", "A valley with Qualcomm supplier offices.", "l3")]
    got = discovery.extract_candidates(spark.createDataFrame(hits, "company string, seq int, title string, snippet string, link string"), Identities(spark))
    return got.filter(F.col("name").isin("TSMC", "ASE Technology") | F.col("name").contains("Valley")).select("name", "tier")


@gives("name string, canonical string, location string, products string, criticality string, links string", ("Hon Hai Precision Industry", "Hon Hai Precision Industry Co., Ltd.", "Taiwan", "a;b", "Medium", "x;y"), ("Acme", "Acme", "Here", "c", "Low", "z"))
def merged_suppliers(spark, sf_dir):
    """Three names of one company as one row; a single row keeps its values."""
    rows = [("Foxconn", "Unknown (Verified by Research)", "b", 0.8, "x"), ("Hon Hai Precision Industry", "Taiwan", "a", 0.9, "y"), ("Hon Hai Technology Group", "China", "a", 0.7, "x"), ("Acme", "Here", "c", 0.9, "z")]
    df = spark.createDataFrame([(i, n, loc, [p], 1, "Low", c, c, "T", ["T", n], [("t", link, "same")]) for i, (n, loc, p, c, link) in enumerate(rows)], f"seq long, name string, location string, products array<string>, tier int, criticality string, discovery_confidence double, propagated_confidence double, parent string, path array<string>, evidence {EVIDENCE}")
    ids = Identities(spark)
    got = suppliers.merged(ids.resolve(df, "name", "canonical"), ids)
    return got.select("name", "canonical", "location", F.array_join("products", ";").alias("products"), "criticality", F.array_join(F.col("evidence.link"), ";").alias("links"))


@gives("name string, parent string", ("A", "R"), ("C", "R"), ("B", "A"))
def cycles_and_shared_names(spark, sf_dir):
    """Edges back to what was met, and to itself, add nothing; a shared name comes out once."""
    rows = [("R", "A", 0.9), ("A", "B", 0.9), ("B", "A", 0.9), ("B", "R", 0.9), ("A", "A", 0.9), ("R", "C", 0.8), ("C", "B", 0.9)]
    edges = spark.createDataFrame([(s, n, c, i) for i, (s, n, c) in enumerate(rows)], "source string, name string, confidence double, seq long")
    return graph.expand_tiers(edges, "R", graph.Limits(max_depth=5)).select("name", "parent")


@gives("name string, tier int", ("A", 1), ("X", 2))
def gates_by_tier(spark, sf_dir):
    """Edges are taken only in tiers whose gate they passed."""
    rows = [("R", "A", 1), ("R", "A", 2), ("R", "B", 2), ("A", "X", 1), ("A", "X", 2), ("A", "Y", 1), ("X", "Z", 1)]
    edges = spark.createDataFrame([(s, n, 0.9, i, t) for i, (s, n, t) in enumerate(rows)], "source string, name string, confidence double, seq long, gate_tier int")
    return graph.expand_tiers(edges, "R", graph.Limits(max_depth=3)).select("name", "tier")


@gives("name string, value int", ("a", 3), ("b", 2), ("c", None))
def shared_aliases(spark, sf_dir):
    """Rows that share any of their names, compared by keys; the last in order counts."""
    left = spark.createDataFrame([("a", ["Acme, Inc"]), ("b", ["q", "Other"]), ("c", [])], "name string, names array<string>")
    right = spark.createDataFrame([(["acme inc"], 1, 1), (["OTHER"], 2, 2), (["x", "ACME inc."], 3, 3)], "names array<string>, o int, value int")
    return control.alias_lookup(left, right, "names", "names", "o").select("name", F.col("match.value").alias("value"))


@gives("key string, v int, dropped long", ("a", 1, 2), ("b", 5, None))
def budgets(spark, sf_dir):
    """The first row of each key, and how many a budget of one left out."""
    rows = spark.createDataFrame([("a", 3), ("a", 1), ("a", 2), ("b", 5)], "key string, v int")
    kept, audit = control.within_budget(rows, ["v"], 1, "key")
    return kept.join(audit, "key", "left").select("key", "v", "dropped")


@gives("kept long, dropped long", (2, 2))
def overall_budget(spark, sf_dir):
    rows = spark.createDataFrame([("a", 3), ("a", 1), ("a", 2), ("b", 5)], "key string, v int")
    kept, audit = control.within_budget(rows, ["v"], 2)
    return kept.agg(F.count("*").alias("kept")).join(audit.select("dropped"))


_TYPOS = {"Samsung Electroncis": "Samsung Electronics", "Hon Hai Precision Industyr": "Hon Hai Precision Industry Co., Ltd.", "Taiwan Semiconductor Manufacturing Compnay": "Taiwan Semiconductor Manufacturing Company", "Some Ohter Works": "Some Ohter Works"}


@gives("typo string, canonical string", *_TYPOS.items())
def misspelt_names(spark, sf_dir):
    """Aliases with two letters exchanged, and a name that is close to none."""
    return Identities(spark).resolve(spark.createDataFrame([(x,) for x in _TYPOS], "typo string"), "typo")


@gives("number long, v int", *((i, i + 1) for i in range(9)))
def overall_numbers(spark, sf_dir):
    return relational.numbered_overall(spark.createDataFrame([(v,) for v in (4, 9, 1, 7, 2, 8, 3, 6, 5)], "v int"), ["v"])
