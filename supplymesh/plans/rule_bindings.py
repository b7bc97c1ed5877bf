"""The library's rules applied to the tables, each with SQL that works the rule out from the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from supplymesh.functions import evidence, risk, scoring
from supplymesh.operators import discovery, signals, suppliers
from supplymesh.plans.bindings import _table, bound
from supplymesh.sources import reference_data as R
from supplymesh.sources import tables


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _listed(words) -> str:
    return "[" + ", ".join(map(_quoted, words)) + "]"


def _has(column: str, words) -> str:
    """Whether a lower-cased text has any of the words, also within others."""
    return f"(len(list_filter({_listed(words)}, lambda w: contains({column}, w))) > 0)"


#: Sentences that are put behind documents, by their number, so that rules about supply and risk have something to find.
SAID = (
    "The firm supplies components to others.", "It is a foundry for chips and a strategic partner.", "It was acquired by an investor last year.", "A fire at the plant caused a severe disruption.",
    "Nothing else is known.", "The company filed for bankruptcy, and layoffs hit its workforce.", "A supply agreement lists each vendor; a customer asked for more.", "Workers plan a strike over a warning of weak demand.", "Sources chips from foundries including one in Taiwan, where conflict is near.",
)
_SAID_SQL = f"text || ' ' || {_listed(SAID)}[1 + doc_id % {len(SAID)}]"


def _said(spark, sf_dir):
    """Documents (doc_id, text) with a sentence behind their text, by their number."""
    said = F.element_at(F.array(*map(F.lit, SAID)), (1 + F.col("doc_id") % len(SAID)).cast("int"))
    return _table(spark, sf_dir, "documents").select("doc_id", F.concat("text", F.lit(" "), said).alias("text"))


_PLAIN = "lower(trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(x, '<[^>]+>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&#x27;', ''''), '&apos;', ''''), '&copy;', '©'), '&middot;', '·'), '&amp;', '&'), '[ \\t\\n\\r\\f\\v]+', ' ', 'g')))"
_HITS = lambda patterns: f"len(list_filter({_listed(patterns)}, lambda p: regexp_matches(t, p, 'i')))"
_ANALYSED = f"""
texts as (select doc_id, {_PLAIN} t from (select doc_id, {_SAID_SQL} x from documents)),
counted as (select doc_id, {_HITS(R.STRONG)} strong, {_HITS(R.MEDIUM)} medium, {_HITS(R.WEAK)} weak, least(1, {_HITS(R.AGAINST)}) negative from texts),
analysed as (select *, 5 * strong + 3 * medium + weak score, cast(strong + medium + weak > 0 as int) supporting from counted)
"""


def _with_evidence(spark, sf_dir):
    item = F.struct(F.lit("").alias("title"), F.lit("").alias("link"), F.col("text").alias("snippet"))
    return signals.with_analysis(_said(spark, sf_dir).select("doc_id", F.array(item).alias("evidence")))


@bound(f"with {_ANALYSED} select doc_id, strong::int strong, medium::int medium, weak::int weak, negative::int negative, supporting, score::int score from analysed")
def evidence_signals(spark, sf_dir):
    """Signals of supply in all documents, through the index of the patterns' literals."""
    return _with_evidence(spark, sf_dir).select("doc_id", "analysis.strong", "analysis.medium", "analysis.weak", "analysis.negative", "analysis.supporting", "analysis.score")


@bound(f"""
with {_ANALYSED} select doc_id, tier::int tier, case when tier = 1 then case when strong + medium + weak = 0 then false when negative > 0 and score < 5 then false else doc_id % 2 = 0 end when negative > 0 and score < least + 3 then false else score >= least end accepted
from (select *, case tier when 2 then 3 when 3 then 5 else 0 end least from analysed, (values (1), (2), (3)) v(tier))
""")
def gate_without_names(spark, sf_dir):
    """Whether a document's evidence carries a relationship in each of three tiers, with a high confidence for every other document."""
    confidence = F.when(F.col("doc_id") % 2 == 0, 0.9).otherwise(0.7)
    told = _with_evidence(spark, sf_dir).withColumn("tier", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))
    nothing = [F.lit(None).cast("boolean").alias(n) for n in ("source", "candidate", "linked", "reverse")]
    accepted = evidence.gate_of(F.struct(F.col("analysis").alias("a"), F.lit(True).alias("some"), *nothing), F.col("tier"), confidence)["accepted"]
    return told.select("doc_id", "tier", accepted.alias("accepted"))


@bound(f"""
with {_ANALYSED} select doc_id, cast(round(greatest(0, least(1.0, score / 10.0) * 0.7 + least(1.0, supporting / 2.0) * 0.3 - case when negative > 0 then 0.15 else 0 end), 2) as double) quality from analysed
""")
def evidence_quality(spark, sf_dir):
    return _with_evidence(spark, sf_dir).select("doc_id", evidence.quality_of(F.col("analysis")).alias("quality"))


def _cascade(text: str, cases) -> str:
    return "case " + " ".join(f"when {test} then {result}" for test, result in cases) + " end"


_FINANCE = _cascade("t", (
    (_has("t", risk.BANKRUPTCY), f"case when {_has('t', risk.BANKRUPTCY_OWN)} then 'Critical' when {_has('t', risk.BANKRUPTCY_CUSTOMER)} then 'High' end"), (_has("t", risk.FINANCE_HIGH), "'High'"),
    (_has("t", risk.LAYOFF), f"case when {_has('t', risk.LAYOFF_OWN)} or contains(t, 'zulieferer') then 'Medium' end"), (_has("t", risk.FINANCE_MEDIUM), "'Medium'"), (_has("t", risk.FINANCE_LOW), "'Low'"),
))


@bound(f"""
select * from (select doc_id, {_FINANCE} severity, len(list_filter({_listed(risk.BANKRUPTCY + risk.LAYOFF)}, lambda w: contains(t, w)))::int words from (select doc_id, lower('News ' || {_SAID_SQL}) t from documents)) where severity is not null
""")
def financial_risks(spark, sf_dir):
    """Financial risks that documents tell of, as news items titled alike."""
    from supplymesh.functions.text import matched

    told = _said(spark, sf_dir).withColumn("r", risk.financial_risk(F.lit("Zulieferer"), F.lit("News"), F.col("text")))
    words = F.size(matched(F.col("text"), risk.BANKRUPTCY + risk.LAYOFF))
    return told.select("doc_id", "r.severity", words.alias("words")).filter("severity is not null")


@bound(f"""
with told as (select doc_id, case doc_id % 4 when 0 then 'News' when 1 then 'Verification' when 2 then 'financial' else 'other' end kind, {_SAID_SQL} t from documents),
low as (select doc_id, kind, lower(kind || ' ' || t) x from told)
select doc_id, kind, not {_has('x', risk.DATA_QUALITY)} and (lower(kind) in ({", ".join(map(_quoted, risk.EXTERNAL_TYPES))}) or {_has('x', risk.EXTERNAL)}) "external" from low
""")
def external_risks(spark, sf_dir):
    """Which risks lie outside the data, by type and reasoning."""
    kind = F.element_at(F.array(*map(F.lit, ("News", "Verification", "financial", "other"))), (1 + F.col("doc_id") % 4).cast("int"))
    told = _said(spark, sf_dir).withColumn("kind", kind)
    return told.select("doc_id", "kind", risk.is_external(F.col("kind"), F.col("text")).alias("external"))


@bound(f"""
with told as (select doc_id, source, lower({_SAID_SQL}) t from documents)
select doc_id, case when contains(t, lower(source)) then 5 else 0 end + 2 * len(list_filter({_listed(R.SEARCH_KEYWORDS)}, lambda w: contains(t, w)))::int quality from told
""")
def search_hit_quality(spark, sf_dir):
    """How good a hit each document would be for a search after its source."""
    told = _said(spark, sf_dir).join(_table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    return told.select("doc_id", scoring.search_quality(F.col("source"), F.col("text")).alias("quality"))


#: Industries of names whose own isn't known.
INDUSTRIES = {"Customer#000000003": "Optics", "customer#000000006": "Steel", "CUSTOMER#000000007": "never, as its own is known"}


@bound("""
select c_custkey, case when c_custkey % 3 <> 0 then c_mktsegment when lower(c_name) = 'customer#000000003' then 'Optics' when lower(c_name) = 'customer#000000006' then 'Steel' when c_custkey % 2 = 0 then 'Unknown' when c_custkey % 9 = 0 then '' end industry from customer
""")
def industries(spark, sf_dir):
    """Market segments of customers, every third of which is missing in one way or another, with what is known by name."""
    k = F.col("c_custkey")
    own = F.when(k % 3 != 0, F.col("c_mktsegment")).when(k % 2 == 0, "Unknown").when(k % 9 == 0, "")
    return _table(spark, sf_dir, "customer").select("c_custkey", scoring.industry_fallback(F.col("c_name"), own, INDUSTRIES).alias("industry"))


_RATED = """
rated as (select s_suppkey, s_suppkey % 5 + 5 d, s_suppkey % 7 + 3 r, 4 * (1 + s_suppkey % 2) v, s_suppkey % 3 <> 0 verified, case when s_acctbal < 0 then 'Critical' when s_acctbal < 2500 then 'High' when s_acctbal < 5000 then 'Medium' when s_acctbal < 7500 then 'Low' end worst, s_acctbal > 3000 wide from supplier),
scored as (select *, least(2.0 * d + 3.0 * r + case when verified then 3.5 * v else 1.75 * v end + case worst when 'Critical' then 3 when 'High' then 6 when 'Medium' then 9 when 'Low' then 12 else case when wide then 11.25 else 8.25 end end, case when wide then 100 else 60 end) points from rated)
"""


def _rated(spark, sf_dir):
    k, balance = F.col("s_suppkey"), F.col("s_acctbal")
    rated = _table(spark, sf_dir, "supplier").select(
        "s_suppkey", ((k % 5 + 5) / 10).alias("discovery"), ((k % 7 + 3) / 10).alias("relationship"), ((1 + k % 2) * 0.4).alias("verification"), (k % 3 != 0).alias("verified"),
        F.when(balance < 0, "Critical").when(balance < 2500, "High").when(balance < 5000, "Medium").when(balance < 7500, "Low").alias("worst"), F.when(balance > 3000, 0.9).otherwise(0.4).alias("coverage"), F.when(balance > 3000, 1.0).otherwise(0.6).alias("cap"),
    )
    score = scoring.confidence(*(F.col(c) for c in ("discovery", "relationship", "verification", "verified", "worst", "coverage", "cap")))
    return rated.withColumn("final_confidence", score)


@bound(f"with {_RATED} select s_suppkey, worst, cast(round(points) as int) points from scored")
def supplier_confidence(spark, sf_dir):
    """Confidence in each supplier by discovery, relationship, verification, and worst risk, under the cap of its coverage, in hundredths."""
    return _rated(spark, sf_dir).select("s_suppkey", "worst", F.round(F.col("final_confidence") * 100).cast("int").alias("points"))


@bound("""
with found as (select s_suppkey, s_suppkey % 2 = 0 known, s_suppkey % 3 = 0 seen, s_suppkey % 6 < 3 related, (s_suppkey % 10)::double / 10 r, (s_suppkey % 4)::double / 4 q, (s_suppkey % 5)::double / 5 s from supplier),
there as (select *, case when known then 0.92 when seen then 0.8 end::double e0, related and r >= 0.65 and q >= 0.5 ok from found),
totals as (select *, coalesce(e0, case when ok and known then 0.86 end)::double e from there),
scored as (select *, coalesce(e, 0::double) * 0.25::double + case when ok then r else least(r, 0.35::double) end * 0.35::double + q * 0.25::double + s * 0.15::double total from totals),
capped as (select *, case when e is null then least(total, 0.35) else total end t1 from scored), done as (select *, least(1.0, case when ok then t1 else least(t1, 0.55) end) t2 from capped)
select s_suppkey, e is not null company_exists, ok relationship_verified, cast(round(t2 * 1000000) as int) millionths, e is not null and ok and t2 >= 0.55 verified from done
""")
def verification_scores(spark, sf_dir):
    """Whether suppliers exist and their relationship is verified, and how sure that is."""
    k, none = F.col("s_suppkey"), F.array().cast("array<struct<title:string,link:string,snippet:string>>")
    known, kind = k % 2 == 0, F.when(k % 6 < 3, "supplier").otherwise("partner")
    there = scoring.existence(known, k % 3 == 0, F.lit("Steel"), F.lit(None).cast("string"), none)
    told = scoring.verification(there, known, kind, (k % 10) / 10, (k % 4) / 4, (k % 5) / 5)
    return _table(spark, sf_dir, "supplier").select("s_suppkey", told.alias("v")).select("s_suppkey", "v.company_exists", "v.relationship_verified", F.round(F.col("v.confidence_score") * 1_000_000).cast("int").alias("millionths"), "v.verified")


@bound("""
with risks as (select user_id, event_id, case event_type when 'error' then 'Critical' when 'purchase' then 'High' when 'signup' then 'Medium' else 'Low' end severity, case event_type when 'error' then 4 when 'purchase' then 3 when 'signup' then 2 else 1 end o from events where value > 200),
ranked as (select *, count(*) over (partition by user_id) n, row_number() over (partition by user_id order by o desc, event_id) k from risks)
select user_id, event_id, severity, cast(row_number() over (partition by user_id order by case when n <= 3 then event_id else k end) as int) place from ranked where k <= 3
""")
def top_risks(spark, sf_dir):
    """The three most severe of each user's events; in their own order where there are no more."""
    kind = F.col("event_type")
    severity = F.when(kind == "error", "Critical").when(kind == "purchase", "High").when(kind == "signup", "Medium").otherwise("Low")
    risks = _table(spark, sf_dir, "events").filter("value > 200").select("user_id", "event_id", F.col("event_id").alias("seq"), severity.alias("severity"))
    return suppliers.top_risks(risks, "user_id").select("user_id", "event_id", "severity", "place")


@bound("""
with found as (select distinct l_suppkey, l_partkey from lineitem where l_returnflag = 'R'), expected as (select distinct l_suppkey, l_partkey from lineitem where l_linestatus = 'F'),
matches as (select coalesce(f.l_suppkey, e.l_suppkey) k, f.l_partkey f, e.l_partkey e from found f full join expected e on f.l_suppkey = e.l_suppkey and f.l_partkey = e.l_partkey)
select cast(k as varchar) company, count(*) filter (where f is not null and e is not null) true_positives, count(*) filter (where e is null) false_positives, count(*) filter (where f is null) false_negatives,
coalesce(round(count(*) filter (where f is not null and e is not null) / nullif(count(f), 0)::decimal(18, 6), 3), 0)::double "precision", coalesce(round(count(*) filter (where f is not null and e is not null) / nullif(count(e), 0)::decimal(18, 6), 3), 0)::double recall from matches group by k
""")
def benchmark_evaluation(spark, sf_dir):
    """Parts that each supplier got back against those of its finished lines, as precision and recall."""
    lines = _table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").cast("string").alias("company"), F.col("l_partkey").alias("canonical"), "l_returnflag", "l_linestatus")
    return suppliers.evaluation(lines.filter("l_returnflag = 'R'"), lines.filter("l_linestatus = 'F'"))


_XML = lambda c: f"replace(replace(replace({c}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


@bound("""
with turns as (select conv_id, turn, case when turn % 4 = 3 then '' else substr(text, 1, 12) end title, replace(substr(text, 1, 40), chr(10), ' ') snippet from conversations where conv_id % 7 <> 0 and text is not null),
first as (select *, row_number() over (partition by conv_id, trim(title) order by turn) n from turns where trim(title) <> '')
select conv_id, cast(row_number() over (partition by conv_id order by turn) - 1 as int) item, trim(replace(title, chr(10), ' ')) title, trim(snippet) snippet from first where n = 1
""")
def feed_items(spark, sf_dir):
    """Conversations written as feeds, an item for each turn, and read again; feeds that aren't XML, and turns without a title, give nothing, and a title counts once."""
    plain = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    turn = F.col("turn")
    title = F.when(turn % 4 == 3, "").otherwise(F.substring("text", 1, 12))
    item = F.concat(F.lit("<item><title>"), plain(title), F.lit("</title><description>"), plain(F.replace(F.substring("text", 1, 40), F.lit("\n"), F.lit(" "))), F.lit("</description><link>x</link></item>"))
    turns = _table(spark, sf_dir, "conversations").filter("text is not null").select("conv_id", F.struct("turn", item.alias("x")).alias("t"))
    feeds = turns.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("t")), lambda t: t["x"]), "").alias("items"))
    payload = F.when(F.col("conv_id") % 7 == 0, "no feed").otherwise(F.concat(F.lit("<rss><channel>"), F.col("items"), F.lit("</channel></rss>")))
    read = tables.feed_items(feeds.select(F.col("conv_id").alias("supplier_name"), F.lit("turns").alias("feed"), F.lit(0).alias("seq"), payload.alias("payload")))
    clean = lambda c: F.trim(F.replace(F.col(c), F.lit("\n"), F.lit(" ")))
    return read.select(F.col("supplier_name").alias("conv_id"), "item", clean("title").alias("title"), clean("snippet").alias("snippet"))


@bound("""
select s_suppkey, case when s_suppkey % 5 = 0 then 'Not found' else s_name || ' makes and ships parts of many kinds to customers in all regions.' end description, case when s_suppkey % 3 = 0 then 'Not found' else 'Industry ' || s_nationkey end industry, 'Town ' || s_nationkey headquarters, case when s_suppkey % 2 = 0 then 'www.s' || s_suppkey || '.example' end website from supplier
""")
def infobox_profiles(spark, sf_dir):
    """Suppliers' pages with an infobox, some without a paragraph, an industry or a website, and the profiles in them."""
    k, town = F.col("s_suppkey"), F.col("s_nationkey").cast("string")
    row = lambda head, cell: F.concat(F.lit(f"<tr><th>{head}</th><td>"), cell, F.lit("</td></tr>"))
    box = F.concat(F.lit('<table class="infobox vcard">'), F.when(k % 3 == 0, "").otherwise(row("Industry", F.concat(F.lit("Industry "), town))), row("Headquarters", F.concat(F.lit("Town "), town)), F.when(k % 2 == 0, row("Website", F.concat(F.lit("www.s"), k.cast("string"), F.lit(".example")))).otherwise(""), F.lit("</table>"))
    text = F.when(k % 5 == 0, "<p>Short.</p>").otherwise(F.concat(F.lit("<p>"), F.col("s_name"), F.lit(" makes and ships parts of many kinds to customers in all regions.</p>")))
    pages = _table(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit("<html><body>"), box, text, F.lit("</body></html>")).alias("html"))
    return tables.profiles_of_pages(pages).select("s_suppkey", "profile.*")


@bound(f"""
select n_name company, cast(generate_subscripts({_listed(R.QUERIES)}, 1) - 1 as int) seq, n_name || ' ' || unnest({_listed(R.QUERIES)}) "query" from nation
""")
def search_queries(spark, sf_dir):
    """What is searched for about each nation."""
    return discovery.queries(_table(spark, sf_dir, "nation"), "n_name").select("company", "seq", "query")
