"""Discovery of candidate suppliers: layered sources, queries, extraction from search results."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from supplymesh.functions import candidates as C
from supplymesh.functions import evidence as E
from supplymesh.functions import scoring as S
from supplymesh.functions.names import compact_key, let
from supplymesh.functions.text import sentences, strip_markup
from supplymesh.operators.relational import first_per_key, topk_per_key
from supplymesh.operators.resolve import Identities
from supplymesh.sources import reference_data as R


def queries(companies: DataFrame, company: str = "company") -> DataFrame:
    """(company, seq, query): a company's own query templates, then the general ones; each query once, whatever its case."""
    spark = companies.sparkSession
    own = [(k, i, q) for k, v in R.OWN_QUERIES.items() for i, q in enumerate(v)]
    rows = spark.createDataFrame(own, "k string, i int, q string")
    general = spark.createDataFrame([(100 + i, q) for i, q in enumerate(R.QUERIES)], "i int, q string")
    base = companies.select(F.col(company).alias("company")).distinct()
    mine = base.join(F.broadcast(rows), F.lower("company") == F.col("k")).select("company", "i", "q")  # both tables are fixed
    every = mine.unionByName(base.join(F.broadcast(general)).select("company", "i", "q")).withColumn("query", F.concat("company", F.lit(" "), "q"))
    once = first_per_key(every.withColumn("low", F.lower("query")), ["company", "low"], ["i"])
    return once.select("company", (F.row_number().over(W.partitionBy("company").orderBy("i")) - 1).alias("seq"), "query")


@dataclass(frozen=True)
class Layers:
    """How layered sources are used."""

    prefer_curated: bool = True
    cache: bool = True
    refresh: bool = False
    cache_only: bool = False


def layered(companies: DataFrame, curated: DataFrame, versions: Sequence[DataFrame], live: DataFrame, existing: Sequence[DataFrame], how: Layers = Layers()) -> DataFrame:
    """Rows of the first layer that answers for each company, with ``layer``.

    Layers are the curated one, cache versions from the newest on, and live rows; all have a column company. ``existing``: for each version the
    companies that have a file in it. A newest file that exists but has no rows left sends its company to live rows, never to older versions.
    Refreshing, or leaving out the cache, also leaves out the curated layer. Cache only: no live rows, and with curated rows preferred, no cache either.
    """
    use_curated = how.prefer_curated and how.cache and not how.refresh
    use_cache = how.cache and not how.refresh and not (how.cache_only and how.prefer_curated)
    left, parts = companies.select("company").distinct(), []

    def take(rows: DataFrame, name: str) -> None:
        parts.append(rows.join(left, "company", "left_semi").withColumn("layer", F.lit(name)))

    if use_curated:
        take(curated, "curated")
        left = left.join(curated.select("company").distinct(), "company", "left_anti")
    waiting = left
    if use_cache:
        for i, (rows, there) in enumerate(zip(versions, existing)):
            here = waiting.join(there.select("company").distinct(), "company", "left_semi")
            parts.append(rows.join(here, "company", "left_semi").withColumn("layer", F.lit(f"cache {i}")))
            left = left.join(rows.join(here, "company", "left_semi").select("company").distinct(), "company", "left_anti")
            waiting = waiting.join(there.select("company").distinct(), "company", "left_anti") if i == 0 else waiting.join(rows.select("company").distinct(), "company", "left_anti")
    if not how.cache_only:
        take(live, "live")
    if not parts:
        return live.limit(0).withColumn("layer", F.lit("live"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def layered_files(files: DataFrame, how: Layers = Layers()) -> DataFrame:
    """Rows of the layer that answers for each company: company, layer, seq, and what the payload's rows hold. The same precedence as layered(), decided by one pass over the files.

    files is (company, layer, payload), a row for each stored file, as tables.versioned_files reads them; layers are curated, cache-0 (the newest version), cache-1 and so on, and live.
    A file without usable rows is still a file: a newest version that is there and empty sends its company to live rows, never to older versions."""
    use_curated = how.prefer_curated and how.cache and not how.refresh
    use_cache = how.cache and not how.refresh and not (how.cache_only and how.prefer_curated)
    usable = F.filter(F.from_json("payload", CACHED, {"mode": "PERMISSIVE"}), lambda r: r["name"].isNotNull() & C.rejection(r["name"], F.lit(False)).isNull())
    version = F.regexp_extract("layer", "^cache-([0-9]+)$", 1)
    read = files.select("company", "layer", usable.alias("rows"), F.when(version != "", version.cast("int")).alias("version")).withColumn("some", F.coalesce(F.size("rows") > 0, F.lit(False)))
    of = W.partitionBy("company")
    any_of = lambda test: F.coalesce(F.max(test).over(of), F.lit(False))
    older = F.min(F.when((F.col("version") > 0) & F.col("some"), F.col("version"))).over(of)
    choice = F.when(F.lit(use_curated) & any_of((F.col("layer") == "curated") & F.col("some")), "curated")
    choice = choice.when(F.lit(use_cache) & any_of((F.col("version") == 0) & F.col("some")), "cache-0")
    choice = choice.when(F.lit(use_cache) & ~any_of(F.col("version") == 0) & older.isNotNull(), F.concat(F.lit("cache-"), older.cast("string")))
    choice = choice if how.cache_only else choice.otherwise("live")
    chosen = read.withColumn("choice", choice).filter((F.col("layer") == F.col("choice")) & F.col("some"))
    return chosen.select("company", "layer", F.posexplode("rows").alias("seq", "row")).select("company", "layer", "seq", "row.*")


CACHED = "array<struct<name:string,location:string,products:array<string>,tier:int,criticality:string,confidence:double,justification:string,source_evidence:array<struct<title:string,link:string,snippet:string>>>>"


def sanitised(cached: DataFrame, payload: str, known: Column | None = None) -> DataFrame:
    """Rows of cached JSON lists with a usable name; anything that isn't a list of objects gives none."""
    parsed = cached.withColumn("__rows", F.from_json(payload, CACHED, {"mode": "PERMISSIVE"}))
    rows = parsed.select(*[c for c in cached.columns if c != payload], F.posexplode("__rows").alias("seq", "__row")).select("*", "__row.*").drop("__row")
    return rows.filter(F.col("name").isNotNull() & C.rejection(F.col("name"), known if known is not None else F.lit(False)).isNull())


def page_context(pages: DataFrame, company: str = "company", extract: str = "extract", most: int = 12) -> DataFrame:
    """The first sentences of page extracts that are about manufacturing, as search hits of quality 8."""
    each = pages.select(company, "title", F.posexplode(sentences(F.regexp_replace(extract, r"\s+", " "))).alias("i", "snippet"))
    kept = topk_per_key(each.filter(E.about_manufacturing(F.col("snippet"))), [company, "title"], ["i"], most)
    return kept.select(F.col(company).alias("company"), "title", "snippet", F.concat(F.lit("https://en.wikipedia.org/wiki/"), F.replace("title", F.lit(" "), F.lit("_"))).alias("link"), F.lit(8).alias("quality_score"), "i")


# Titles that name no company; what a text says about a candidate, in the order in which it is looked for.
TITLES = r"(?i)^List of|^Criticism of|^History of|^Timeline of|^Environmental impact of|Litigation|Lawsuit|Codenames|Products of|Controversies|Silicon Valley|Cupertino|California|^The |Original design manufacturer|Integrated device manufacturer|Board support package|Booting process|Foundry model|Fair Trade Commission|World Is Flat|Rights Advocates|businessman|Chief Supply Chain Officer|Operations at|Senior Vice President|Executive|Director of|ChatGPT|PyTorch|TensorFlow|Open source|Software|Algorithm"
LISTS = r"(?i)^(?:list of|history of|timeline of|criticism of|products of)\b"
NOISE = r"multinational corporation|designs and|manufactures consumer|based in"
RELATIONS = {
    "SUPPLIER": "supplies|supplier|supplied by|provides|manufactures|fabricates|foundry|foundries|vendor|contractor|contract manufacturer|component|parts|semiconductor|oem|odm|original design manufacturer|assembly partner|packaging partner|manufacturing partner|outsourced its manufacturing|outsourced manufacturing|wafer fabrication|chip packaging|osat",
    "PARTNER": "partnership|partner|collaboration|joint venture|alliance|cooperation",
    "ACQUISITION": "acquired|merger|acquisition|bought|subsidiary|parent",
    "COMPETITOR": "competitor|rival|competes|competition|competing|vs|versus",
    "LAWSUIT": "lawsuit|litigation|sued|infringement|court|legal action|dispute",
}
DIRECT = (
    r"\b([A-Z][A-Za-z0-9\s&]{2,40}\b(?:Inc|Ltd|Corp|Group|Co|PLC|Corporation|Limited))\b",
    r"\b([A-Z][A-Za-z0-9\s&]{2,30})\b (?:supplies|provides|manufactures|manufactured|assembles|assembled|is a supplier)",
    r"(?:assembled|manufactured|fabricated|packaged|built|produced|supplied) by (?:original design manufacturer\s+\(ODM\)\s+|ODM\s+|OSAT\s+)?\b([A-Z][A-Za-z0-9\s&]{2,40})\b",
    r"outsourced\s+(?:its\s+)?manufacturing\s+after\s+\b([A-Z][A-Za-z0-9\s&]{2,40})\b\s+was\s+spun\s+off",
)
IN_LISTS = (
    r"(?i)\bproduction\s+with\s+(?:other\s+)?foundries\s+including\s+([^.;]+)", r"(?i)\bfoundries\s+including\s+([^.;]+)",
    r"(?i)\b(?:suppliers|vendors|manufacturing partners|contract manufacturers|original design manufacturers|ODMs|OSATs)\s+(?:including|such as|like)\s+([^.;]+)",
)


def _list_items(fragment: Column) -> Column:
    part = F.get(F.split(fragment, r"(?i)\b(?:with|which|that|where|while|because|after|before|through)\b"), F.lit(0))
    return F.split(F.regexp_replace(F.regexp_replace(part, r"(?i)\s+(?:and|or|as well as)\s+", ", "), r"\s*/\s*", ", "), ",")


def relation(name: Column, target: Column, text: Column, title: Column) -> Column:
    """What a lower-cased text says about a candidate and a target."""
    n, t = F.lower(name), F.lower(target)
    near = lambda *parts: F.regexp_like(text, F.concat(F.lit("(?s)"), *(F.lit(p) if isinstance(p, str) else F.concat(F.lit(r"\Q"), p, F.lit(r"\E")) for p in parts)))
    said = F.when(near(t, ".*?(?:supplies|provides|manufactures|assembled\\s+for).*?", n) | near(n, ".*?is a (?:customer|client) of.*?", t) | near(n, ".*?contracted.*?to.*?", t), "CUSTOMER")
    for kind, words in RELATIONS.items():
        said = said.when(text.rlike(words), kind)
    versus = (F.contains(title, F.lit(" vs ")) | F.contains(title, F.lit(" versus "))) & F.contains(title, F.regexp_replace(n, "[^a-z0-9]", ""))
    other = F.when(versus, "COMPETITOR").otherwise(F.coalesce(said, F.when(E.about_manufacturing(text), "SUPPLIER"), F.lit("NEUTRAL")))
    return (
        F.when(near(r"\bsupplier\s+of\s+", t, r"[-\s]+based\b"), "CUSTOMER").when(near(r"\b(?:against|overtook)\s+", t, r"\b"), "COMPETITOR").when(F.contains(text, F.lit("technology-sharing")), "CUSTOMER")
        .when(text.rlike("defendant|lawsuit"), "LAWSUIT").when(F.contains(text, F.lit("not using")), "CUSTOMER").otherwise(other)
    )


def extract_candidates(hits: DataFrame, identities: Identities, most: int = 20) -> DataFrame:
    """Candidates (company, name, ...) from search hits (company, seq, title, snippet, link), at most ``most`` for each company, the best first.

    Names come from titles and from phrases and lists in the text; each is cleaned, validated, and kept if its hit mentions both names
    in a context of supply and says nothing against it. What is known of a name is then put together from all its hits."""
    base = hits.withColumn("plain", strip_markup(F.col("snippet"))).withColumn("whole", F.concat_ws(" ", "title", "plain")).filter(~C.is_product(F.col("title")))
    title_ok = ~F.col("title").rlike(LISTS) & ~F.col("title").rlike(TITLES)
    found = [F.when(title_ok, F.array("title")).otherwise(F.array().cast("array<string>"))]
    found += [F.regexp_extract_all("whole", F.lit(p), F.lit(1)) for p in DIRECT]
    own_list = F.concat(F.lit(r"(?i)\b(?:built|manufactured|assembled|produced)\s+for\s+\Q"), F.col("company"), F.lit(r"\E[^.;]{0,120}\bby\b[^.;]{0,120}\b(?:including|such as)\s+([^.;]+)"))
    lists = [F.regexp_extract_all("whole", own_list, F.lit(1)), *(F.regexp_extract_all("whole", F.lit(p), F.lit(1)) for p in IN_LISTS)]
    listed = F.flatten(F.transform(F.flatten(F.array(*lists)), _list_items))
    found.append(F.when(E.about_manufacturing(F.col("whole")), listed).otherwise(F.array().cast("array<string>")))
    raw = base.select("company", "seq", "title", "snippet", "plain", "link", "whole", F.posexplode(F.flatten(F.array(*found))).alias("at", "raw"))
    named = raw.withColumn("name", C.candidate_name(F.col("raw"))).filter(F.length("name") >= 3)
    named = identities.resolve(named, "name", fuzzy=False).withColumn("known", identities.is_known(F.col("name"), F.col("canonical")))
    named = identities.with_variants(named, "canonical", "own")
    companies = identities.with_variants(identities.resolve(hits.select("company").distinct(), "company", "company_canonical", fuzzy=False), "company_canonical", "of").select("company", "of")
    named = named.join(companies, "company")
    targets = F.concat(F.array(F.lower("company")), F.col("of"))
    fine = C.rejection(F.col("name"), F.col("known"), targets).isNull() & ~F.lower("name").rlike(NOISE) & ~F.col("name").rlike(TITLES) & F.col("name").rlike("^[A-Z0-9]")
    named = named.filter(fine).withColumn("e", F.array(F.struct("title", "link", "snippet"))).withColumn("a", E.analysis(F.col("e"))).withColumn("low", F.lower("whole"))
    names = F.array_distinct(F.concat("own", F.array(F.lower("name"))))
    both = E.mentions(F.col("low"), F.col("of")) & E.mentions(F.col("low"), names)
    named = named.filter(both & (E.has_signal(F.col("a")) | E.about_manufacturing(F.col("low"))) & ~((F.col("a.negative") > 0) & (F.col("a.score") < 5)))
    named = named.withColumn("relation", relation(F.col("name"), F.col("company"), F.col("low"), F.lower("title"))).filter(~F.col("relation").isin("COMPETITOR", "CUSTOMER", "LAWSUIT", "ACQUISITION"))
    once = first_per_key(named, ["company", "name", "plain", "link"], ["seq", "at"])
    order = F.struct("seq", "at")
    grouped = once.groupBy("company", "name").agg(
        F.count("*").alias("count"), F.min_by("plain", order).alias("snippet"), F.first("known").alias("known"), F.min(order).alias("first"),
        F.when(F.bool_or(F.col("relation") == "SUPPLIER"), "SUPPLIER").otherwise(F.min_by("relation", order)).alias("relation"),
        F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), F.col("e")[0].alias("e")))), lambda x: x["e"]).alias("evidence"),
    )
    scored = grouped.withColumn("a", E.analysis(F.col("evidence"))).withColumn("confidence", S.discovery_confidence(F.col("count"), F.col("name"), F.col("known"), F.col("relation"), F.col("a")))
    top = topk_per_key(scored, ["company"], [F.desc("confidence"), "first"], most, rank="place")
    sure = F.col("confidence") >= 0.75
    return top.select("company", "place", "name", F.lit(R.UNKNOWN_LOCATION).alias("location"), S.product_tags(F.col("snippet")).alias("products"), F.when(sure, 1).otherwise(2).alias("tier"), F.when(sure, "High").otherwise("Medium").alias("criticality"), "confidence", "relation", "count", F.slice("evidence", 1, 2).alias("evidence"))
