"""The whole analysis of a company's supplier network, from tables to tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from supplymesh.functions import candidates as C
from supplymesh.functions import evidence as E
from supplymesh.functions import risk as K
from supplymesh.functions import scoring as S
from supplymesh.functions.names import compact_key, let
from supplymesh.functions.text import display_label
from supplymesh.operators import discovery, graph, relational, suppliers
from supplymesh.operators.resolve import BROADCAST_NAMES, Identities
from supplymesh.plans.control import Classifier, RiskProvider, Stages, all_risks
from supplymesh.sources import reference_data as R
from supplymesh.sources.scratch import settled


@dataclass(frozen=True)
class Config:
    limits: graph.Limits = field(default_factory=graph.Limits)
    articles: int = 10
    skip_risk: bool = False
    as_of: str | None = None
    #: How curated, cached and extracted edges are layered, and candidates extracted for each company at most.
    layers: discovery.Layers = field(default_factory=discovery.Layers)
    candidates: int = 20


NEWS = "supplier_name string, feed string, seq long, title string, snippet string, pub_date string"


@dataclass(frozen=True)
class Inputs:
    """Tables of a run; all but curated edges may be missing.

    ``edges``: relationships with evidence (default: the curated ones). ``hits``: search hits (company, seq, title, snippet, link). ``pages``: page extracts (company, title,
    extract), read for context of manufacturing. ``caches``: versions of earlier edges, the newest first. ``profiles``: (name, industry, website) of pages found. ``news``: items (NEWS).
    ``expected``: canonical names of tier-1 suppliers."""

    edges: DataFrame | None = None
    hits: DataFrame | None = None
    pages: DataFrame | None = None
    caches: tuple[DataFrame, ...] = ()
    profiles: DataFrame | None = None
    news: DataFrame | None = None
    expected: DataFrame | None = None


def discovered_edges(spark: SparkSession, company: str, given: Inputs, identities: Identities, config: Config = Config()) -> DataFrame:
    """Edges of the first layer that answers for each company: curated ones, caches from the newest on, candidates extracted from search hits and pages."""
    own = (given.edges if given.edges is not None else R.curated_edges(spark)).withColumnRenamed("source", "company")
    if given.hits is None and given.pages is None and not given.caches:
        return own.withColumnRenamed("company", "source")
    columns = ["company", "seq", "name", "location", "products", "confidence", "criticality", "evidence"]
    own = own.select(*columns)
    hits = given.hits.select("company", F.col("seq").cast("long").alias("seq"), "title", "snippet", "link") if given.hits is not None else None
    if given.pages is not None:
        context = discovery.page_context(given.pages).select("company", (F.col("i").cast("long") + 1_000_000).alias("seq"), "title", "snippet", "link")
        hits = context if hits is None else hits.unionByName(context)
    live = own.limit(0)
    if hits is not None:
        found = discovery.extract_candidates(hits, identities, config.candidates).withColumnRenamed("place", "seq")
        live = found.select("company", F.col("seq").cast("long").alias("seq"), "name", "location", "products", "confidence", "criticality", "evidence")
    caches = [c.withColumnRenamed("source", "company").select(*columns) for c in given.caches]
    every = [own.select("company"), live.select("company"), *(c.select("company") for c in caches), spark.createDataFrame([(company,)], "company string")]
    companies = every[0]
    for more in every[1:]:
        companies = companies.unionByName(more)
    return discovery.layered(companies, own, caches, live, [c.select("company") for c in caches], config.layers).drop("layer").withColumnRenamed("company", "source")


def _stage(stages: Stages | None, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """What make gives, settled within its stage's time; without a row if that runs out."""
    if stages is None:
        return settled(make())
    made = make()
    out = None
    with stages.stage(name):
        out = settled(made)
    return made.sparkSession.createDataFrame([], made.schema) if out is None else out


def gated_edges(edges: DataFrame, identities: Identities, target: str) -> DataFrame:
    """Edges (source, seq, name, ...) that may be taken in an expansion from target (a canonical name), with canonical and source_canonical: one row for
    each ``gate_tier`` (1 to graph.GATED) in which the evidence carries the relationship.

    Names are cleaned, and have to be those of organisations other than the source and of no place. A competitor of the target is taken only if evidence says that it supplies
    the target; an unrelated energy company only if evidence says that it supplies the source."""
    out = edges.withColumn("name", C.candidate_name(F.col("name"))).filter("name <> ''")
    out = identities.resolve(out, "name", "canonical")
    out = identities.resolve(out, "source", "source_canonical").withColumn("__target", F.lit(target))
    out = identities.with_variants(identities.with_variants(identities.with_variants(out, "canonical", "cv"), "source_canonical", "sv"), "__target", "tv")
    name, known = F.col("name"), identities.is_known(F.col("name"), F.col("canonical"))
    own = F.concat(F.array(F.lower("source")), "sv")
    named = C.rejection(name, known, own).isNull() & ~C.is_place(name) & C.supplier_name_rejection(name, F.col("confidence"), known).isNull()
    rival = F.col("canonical").isin([b for a, b in R.competitors() if a == target])
    out = settled(out.filter(named).withColumn("text", E.whole_text(F.col("evidence"))))
    out = out.filter(~rival | E.links_candidate(F.col("text"), F.col("cv"), F.col("tv"))).filter(~E.unrelated_energy(name, F.col("text"), F.col("cv"), F.col("sv")))
    passed = lambda x: F.filter(F.sequence(F.lit(1), F.lit(graph.GATED)), lambda tier: E.gate_of(x, tier, F.col("confidence"))["accepted"])
    tiers = let(E.gate_signals(F.col("evidence"), name, F.col("cv"), F.col("sv")), passed)  # the evidence is read once for all tiers
    return out.withColumn("gate_tier", F.explode(tiers)).drop("text", "cv", "sv", "tv", "__target")


def analyse(
    spark: SparkSession, company: str, edges: DataFrame | None = None, news: DataFrame | None = None, expected: DataFrame | None = None, config: Config = Config(), identities: Identities | None = None,
    inputs: Inputs | None = None, classifier: Classifier | None = None, risk_providers: Sequence[RiskProvider] = (), stages: Stages | None = None,
) -> dict[str, DataFrame]:
    """Tables of a run: suppliers, relationships, verifications, risks, coverage, quality, scores, health, nodes, edges, tiers, report, and timings if stages are given.

    ``inputs`` (or edges, news and expected alone): see Inputs. ``classifier``: relationships by another model, for those it answers for (by seq); the rules judge the rest.
    ``risk_providers``: further risks of the kept suppliers. ``stages``: time limits; a stage that exceeds its own gives no rows, and the run goes on."""
    given = inputs or Inputs(edges=edges, news=news, expected=expected)
    news, expected = given.news, given.expected
    ids = identities or Identities(spark)
    target = ids.resolve(spark.createDataFrame([(company,)], "name string"), "name").first().canonical
    known = _stage(stages, "supplier_discovery", lambda: gated_edges(discovered_edges(spark, company, given, ids, config), ids, target))
    walk = graph.expand_tiers(known.select(F.col("source_canonical").alias("source"), F.col("canonical").alias("name"), "confidence", "seq", "gate_tier"), target, config.limits)
    walk = walk.withColumn("gate_tier", F.least("tier", F.lit(graph.GATED)))
    detail = known.select(F.col("source_canonical").alias("parent"), F.col("canonical").alias("name"), "gate_tier", F.col("name").alias("raw"), "location", "products", "criticality", "evidence")
    found = walk.join(detail, ["parent", "name", "gate_tier"]).select("seq", F.col("raw").alias("name"), F.col("name").alias("canonical"), "location", "products", "tier", "criticality", F.col("confidence").alias("discovery_confidence"), F.col("propagated").alias("propagated_confidence"), "parent", "path", "evidence")
    found = settled(relational.first_per_key(found, ["canonical", "parent"], ["seq"]))
    text = F.col("said")
    rivals = F.broadcast(spark.createDataFrame(R.competitors(), "parent string, canonical string")).withColumn("competes", F.lit(True))  # a fixed list
    rel = found.withColumn("said", E.snippets(F.col("evidence"))).join(rivals, ["parent", "canonical"], "left")
    rel = rel.withColumn("r", E.classify(F.col("parent"), F.col("name"), text, F.coalesce("competes", F.lit(False)))).withColumn("r", E.enforce(F.col("r"), text, F.col("tier")))
    if classifier is not None:
        answers = classifier(rel.select("seq", "canonical", "name", "parent", "tier", "said")).select("seq", F.struct("relationship_type", F.col("confidence_score").cast("double").alias("confidence_score"), "reasoning").alias("answer"))
        rel = rel.join(answers, "seq", "left").withColumn("r", F.when(F.col("answer").isNotNull(), E.enforce(F.col("answer"), text, F.col("tier"))).otherwise(F.col("r")))
    relationships = _stage(stages, "relationship_analysis", lambda: rel.select("canonical", "seq", F.col("parent").alias("target_company"), "r.*", F.left("said", F.lit(500)).alias("evidence_text")))
    kept = settled(suppliers.retained(suppliers.merged(found, ids), relationships))
    best = suppliers.best_relationships(relationships).select("canonical", "relationship_type", F.col("confidence_score").alias("rel"))
    v = kept.join(best, "canonical", "left").withColumn("known", ids.is_known(F.col("name"), F.col("canonical"))).withColumn("q", E.evidence_quality(F.col("evidence"))).withColumn("s", E.source_quality(F.col("evidence")))
    v = _with_profile(v, given.profiles)
    exists = S.existence(F.col("known"), F.col("found"), F.col("industry"), F.col("website"), F.col("evidence"))
    v = v.withColumn("v", S.verification(exists, F.col("known"), F.col("relationship_type"), F.coalesce("rel", F.lit(0.0)), F.col("q"), F.col("s")))
    verifications = _stage(stages, "verification", lambda: v.select("canonical", "seq", "relationship_type", F.col("q").alias("evidence_quality"), F.col("s").alias("source_quality"), "v.*"))
    risks = _stage(stages, "risk_analysis", lambda: _risks(spark, kept, verifications, news, ids, config, risk_providers))
    quality = suppliers.verification_quality(kept, verifications)
    coverage = suppliers.discovery_coverage(kept, expected, quality)
    c = coverage.first()
    ratio = c.verification_adjusted_ratio if c else 0.0
    cap = 1.0 if ratio >= 0.8 else 0.78 if ratio >= 0.5 else 0.6 if ratio >= 0.3 else 0.45 if ratio > 0 else 0.25
    scores = settled(suppliers.scored(kept, relationships, verifications, risks, ratio, cap))
    health = suppliers.health(scores, ratio, cap)
    nodes, star = graph.star_graph(scores.select("name", F.col("relationship_type").alias("relationship")), company)
    timed = {"timings": stages.table()} if stages is not None else {}
    return timed | {"suppliers": kept, "relationships": relationships, "verifications": verifications, "risks": risks, "coverage": coverage, "quality": quality, "scores": scores, "health": health, "nodes": nodes, "edges": star, "tiers": graph.tier_edges(walk), "report": report(scores, risks, health, coverage)}


def _with_profile(suppliers: DataFrame, profiles: DataFrame | None) -> DataFrame:
    """suppliers with found, industry and website of the profile whose name is the canonical name or the short one, by keys."""
    if profiles is None:
        return suppliers.withColumns({"found": F.lit(False), "industry": F.lit(None).cast("string"), "website": F.lit(None).cast("string")})
    keyed = profiles.select(compact_key(F.col("name")).alias("k"), "industry", "website").filter("k <> ''")
    one = relational.first_per_key(keyed, ["k"], ["industry", "website"]).select("k", F.struct("industry", "website").alias("p"))
    both = suppliers.withColumns({"__a": compact_key(F.col("canonical")), "__b": compact_key(F.col("name"))})
    both = both.join(one.select(F.col("k").alias("__a"), F.col("p").alias("pa")), "__a", "left").join(one.select(F.col("k").alias("__b"), F.col("p").alias("pb")), "__b", "left")
    p = F.coalesce("pa", "pb")
    return both.withColumns({"found": p.isNotNull(), "industry": p["industry"], "website": p["website"]}).drop("__a", "__b", "pa", "pb")


def _risks(spark: SparkSession, kept: DataFrame, verifications: DataFrame, news: DataFrame | None, ids: Identities, config: Config, providers: Sequence[RiskProvider] = ()) -> DataFrame:
    shape = "supplier_name string, canonical string, seq long, risk_type string, severity string, confidence double, reasoning string, mitigation string"
    if config.skip_risk:
        return spark.createDataFrame([], shape)
    columns = ["supplier_name", "canonical", "seq", "risk_type", "r.severity", "r.confidence", "r.reasoning", "r.mitigation"]
    place = kept.select(F.col("name").alias("supplier_name"), "canonical", F.col("seq").cast("long").alias("seq"), F.lit("Geopolitical").alias("risk_type"), K.geopolitical_risk(F.col("name"), F.col("location"), F.array_join("path", " -> ")).alias("r")).filter("r is not null")
    out = place.select(*columns)
    if news is not None:
        sure = kept.join(verifications.filter("verified").select("canonical"), "canonical", "left_semi").select("canonical", F.col("name").alias("supplier_name"))
        aliases = {}
        for alias, c in ids.pairs:
            aliases.setdefault(c, []).append(alias)
        names = spark.createDataFrame(list(aliases.items()), "canonical string, aliases array<string>")
        names = F.broadcast(names) if len(ids.pairs) <= BROADCAST_NAMES else names
        as_of = F.to_timestamp(F.lit(config.as_of)) if config.as_of else F.current_timestamp()
        fresh = news.filter(F.when(F.col("feed") == "financial", K.recent(F.col("pub_date"), as_of, K.FINANCIAL_DAYS)).otherwise(K.recent(F.col("pub_date"), as_of, K.NEWS_DAYS)))
        items = relational.topk_per_key(fresh, ["supplier_name", "feed"], ["seq"], config.articles).join(sure, "supplier_name").join(names, "canonical", "left").withColumn("aliases", F.coalesce("aliases", F.array().cast("array<string>")))
        n = F.col("supplier_name")
        items = items.withColumn("rel", K.relevance(n, F.col("canonical"), F.col("aliases"), F.col("title"), F.col("snippet"))).filter(F.col("rel") >= K.LEAST_RELEVANCE)
        terms = F.concat(F.array("supplier_name", "canonical"), "aliases")
        press = items.filter("feed <> 'financial'").withColumn("r", K.news_risk(n, terms, F.col("title"), F.col("snippet"))).withColumn("risk_type", F.lit("News"))
        money = items.filter("feed = 'financial'").withColumn("r", K.financial_risk(n, F.col("title"), F.col("snippet"))).withColumn("risk_type", F.lit("Financial"))
        for part in (press, money):
            made = part.filter("r.severity is not null").select(*columns)
            once = relational.distinct_on(made, ["supplier_name", "risk_type", "severity", "reasoning"], ["seq"])
            out = out.unionByName(suppliers.top_risks(once).drop("place"))
    if providers:
        out = out.unionByName(all_risks(kept, list(providers)).select(*out.columns))
    return out


def report(scores: DataFrame, risks: DataFrame, health: DataFrame, coverage: DataFrame) -> DataFrame:
    """Lines (section, part, place, line) of a report, in that order."""
    from pyspark.sql import Window as W

    made = health.select(F.lit(1).alias("section"), F.lit("Health").alias("part"), F.lit(1).alias("place"), F.format_string("Score %.1f, %s: %d suppliers, %d critical, %d at high risk", "overall_score", "status", "supplier_count", "critical_suppliers", "high_risk_suppliers").alias("line"))
    seen = coverage.select(F.lit(2).alias("section"), F.lit("Discovery").alias("part"), F.lit(1).alias("place"), F.format_string("%d of %d expected suppliers, coverage %s", "matched_expected_count", "expected_count", "label").alias("line"))
    number = F.row_number().over(W.partitionBy("tier").orderBy(F.desc("final_confidence"), "name"))
    tiers = scores.select((F.lit(2) + F.col("tier")).alias("section"), F.concat(F.lit("Tier "), F.col("tier").cast("string")).alias("part"), number.alias("place"), F.concat("name", F.lit(": "), display_label(F.col("relationship_type")), F.format_string(", confidence %.2f, criticality %.2f ", "final_confidence", "criticality_score"), "criticality_level").alias("line"))
    order = F.when(F.col("severity") == "Critical", 1).when(F.col("severity") == "High", 2).when(F.col("severity") == "Medium", 3).otherwise(4)
    placed = relational.numbered_overall(risks.withColumn("__order", order), ["__order", "supplier_name", "seq"], "at")
    noted = placed.select(F.lit(90).alias("section"), F.lit("Risks").alias("part"), (F.col("at") + 1).cast("int").alias("place"), F.concat(F.lit("["), "severity", F.lit("] "), "reasoning").alias("line"))
    return made.unionByName(seen).unionByName(tiers).unionByName(noted).orderBy("section", "place")
