"""Queries of the operators that need a join, an index or a merge of their own, bound to the tables, each with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from supplymesh.operators import asof, discovery, fuzzy, graph, phrases, relational
from supplymesh.plans import control
from supplymesh.plans.bindings import _table, bound
from supplymesh.sources import tables
from supplymesh.sources.scratch import kept, shared_path


@bound("""
with recursive n as (select n_name, n_nationkey, row_number() over (order by n_nationkey) a from nation),
c as (select c_name, c_custkey, n_name, a, row_number() over (partition by a order by c_acctbal desc, c_custkey) k from customer join n on c_nationkey = n_nationkey where a <= 6),
p as (select c_name, c_custkey, n_name, row_number() over (order by a, k) i from c where k <= 6),
o as (select i, list(s_name order by n desc, s_suppkey) names from (select p.i, s_name, s_suppkey, count(*) n from p join orders on o_custkey = c_custkey join lineitem on l_orderkey = o_orderkey join supplier on l_suppkey = s_suppkey group by p.i, s_name, s_suppkey) group by i),
turn as (select 0::bigint i, []::varchar[] taken, []::varchar[] own union all
select p.i, list_concat(taken, coalesce(list_filter(o.names, lambda x: not list_contains(taken, x))[1:6], [])), coalesce(list_filter(o.names, lambda x: not list_contains(taken, x))[1:6], []) from turn join p on p.i = turn.i + 1 left join o on o.i = p.i)
select n_name as name, 1 tier, 'World' parent from n where a <= 6 union all select c_name, 2, n_name from p union all select unnest(own), 3, c_name from turn join p using (i)
""")
def tier_choice(spark, sf_dir):
    """Nations, their customers, and the customers' suppliers, six for each parent: suppliers that several customers have go to the earliest of them, and the others take their next ones."""
    nation, customer, supplier = (_table(spark, sf_dir, t) for t in ("nation", "customer", "supplier"))
    shape = lambda df, source, name, confidence, seq: df.select(F.col(source).alias("source"), F.col(name).alias("name"), confidence.cast("double").alias("confidence"), F.col(seq).cast("long").alias("seq"))
    a = shape(nation.withColumn("root", F.lit("World")), "root", "n_name", F.lit(1.0), "n_nationkey")
    b = shape(customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")), "n_name", "c_name", F.col("c_acctbal"), "c_custkey")
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    lines = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_suppkey").alias("s_suppkey")).join(orders, "o_orderkey").groupBy("c_custkey", "s_suppkey").agg(F.count("*").alias("n"))
    c = shape(lines.join(customer.select("c_custkey", "c_name"), "c_custkey").join(supplier.select("s_suppkey", "s_name"), "s_suppkey"), "c_name", "s_name", F.col("n"), "s_suppkey")
    found = graph.expand_tiers(a.unionByName(b).unionByName(c), "World", graph.Limits(max_depth=3, per_parent=6, queue=None, total=None))
    return found.select("name", "tier", "parent")


@bound()
def closest_names(spark, sf_dir):
    """Names of parts and suppliers with their last two letters exchanged and one doubled, and the closest names of the tables. Likeness by matched blocks isn't to be had in SQL: tests compare all pairs."""
    part = _table(spark, sf_dir, "part").select(F.concat("p_name", F.lit(" "), "p_type").alias("key")).distinct()
    known = part.unionByName(_table(spark, sf_dir, "supplier").select(F.col("s_name").alias("key")))
    n = F.length("key")
    typed = F.concat(F.substr("key", F.lit(1), n - 2), F.substr("key", n, F.lit(1)), F.substr("key", n - 1, F.lit(1)), F.substr("key", n - 1, F.lit(1)))
    return fuzzy.closest(known.select(typed.alias("name")), known)


_PHRASES = """
docs as (select doc_id, list_transform(regexp_extract_all(text, '[\\p{L}\\p{N}]+'), lambda w: lower(w)) w from documents),
items as (select item_id, list_transform(regexp_extract_all(text, '[\\p{L}\\p{N}]+'), lambda w: lower(w)) w from benchmark),
phrases as (select 'item ' || item_id phrase_id, w from items union all select 'lead ' || item_id, w[1:2] from items union all select 'part ' || p_name, string_split(p_name, ' ') from (select distinct p_name from part))
"""


def _dictionary(spark, sf_dir):
    items = _table(spark, sf_dir, "benchmark").select("item_id", "text")
    words = F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    parts = _table(spark, sf_dir, "part").select(F.concat(F.lit("part "), "p_name").alias("phrase_id"), F.col("p_name").alias("phrase")).distinct()
    whole = items.select(F.concat(F.lit("item "), F.col("item_id").cast("string")).alias("phrase_id"), F.col("text").alias("phrase"))
    leads = items.select(F.concat(F.lit("lead "), F.col("item_id").cast("string")).alias("phrase_id"), F.array_join(F.slice(words, 1, 2), " ").alias("phrase"))
    return whole.unionByName(leads).unionByName(parts)


@bound(f"""
with {_PHRASES},
found as (select doc_id, phrase_id, unnest(list_filter(range(0, len(docs.w) - len(phrases.w) + 1), lambda i: docs.w[i + 1:i + len(phrases.w)] = phrases.w)) place from docs join phrases on contains(' ' || array_to_string(docs.w, ' ') || ' ', ' ' || array_to_string(phrases.w, ' ') || ' '))
select doc_id, phrase_id, count(*) mentions, cast(min(place) as int) first from found group by doc_id, phrase_id
""")
def passage_mentions(spark, sf_dir):
    """Where documents have a benchmark's passages, the first two words of these, or names of parts."""
    found = phrases.mentions(_table(spark, sf_dir, "documents").select("doc_id", "text"), _dictionary(spark, sf_dir), "doc_id", "text")
    return found.groupBy(F.col("id").alias("doc_id"), "phrase_id").agg(F.count("*").alias("mentions"), F.min("at").alias("first"))


_LINKS = ("to", "for", "with", "by", "from", "für", "mit", "pour", "avec", "para", "con")


@bound(f"""
with pieces as (select doc_id, unnest(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}]+')) p, generate_subscripts(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}]+'), 1) i from documents),
placed as (select doc_id, i, lower(p) w, regexp_matches(p, '^[\\p{{L}}\\p{{N}}]') word, sum(length(p)) over (partition by doc_id order by i) e, e - length(p) s from pieces),
words as (select doc_id, w, s, e from placed where word),
names as (select distinct n from (select unnest(list_transform(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}]+'), lambda x: lower(x))) n from benchmark) where length(n) = 5),
found as (select doc_id, n phrase_id, s, e from words join names on w = n),
links as (select doc_id, w, s, e from words where w in ({", ".join(f"'{w}'" for w in _LINKS)}))
select c.phrase_id candidate, d.phrase_id source, links.w link, count(*) claims, count(distinct c.doc_id) documents from found c join links on links.doc_id = c.doc_id and links.s - c.e between 0 and 120
join found d on d.doc_id = c.doc_id and d.s - links.e between 0 and 120 and d.phrase_id <> c.phrase_id group by all
""")
def claimed_directions(spark, sf_dir):
    """Which words of five letters that benchmark passages have stand before others of them with a link word between them, each at most 120 characters on."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    names = _table(spark, sf_dir, "benchmark").select(F.explode(words).alias("phrase_id")).filter("length(phrase_id) = 5").distinct().withColumn("phrase", F.col("phrase_id"))
    found = kept(phrases.mentions(docs, names, "doc_id", "text"), "phrase-mentions")
    links = phrases.word_positions(docs, "doc_id", "text", frozenset(_LINKS)).join(found.select("id").distinct(), "id", "left_semi")
    claims = phrases.directed(found, links)
    by_document = claims.groupBy("candidate", "source", "link", "id").agg(F.count("*").alias("n"))
    return by_document.groupBy("candidate", "source", "link").agg(F.sum("n").alias("claims"), F.count("*").alias("documents"))


@bound("""
with placed as (select o_custkey, o_orderdate, max(o_orderkey) o_orderkey from orders group by o_custkey, o_orderdate)
select event_id, o_orderkey, o_orderdate from (select event_id, user_id, ts - interval 26 year t from events) e asof left join placed on user_id = o_custkey and t >= o_orderdate
""")
def order_before_event(spark, sf_dir):
    """The last order of each event's user before the event, 26 years earlier."""
    events = _table(spark, sf_dir, "events").select("event_id", "user_id", F.expr("ts - interval 26 years").alias("t"))
    orders = _table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey").withColumnRenamed("o_custkey", "user_id")
    return asof.asof_join(events, orders, "user_id", "t", "o_orderdate", ["o_orderkey", "o_orderdate"], ties=["o_orderkey"]).select("event_id", "o_orderkey", "o_orderdate")


@bound("""
with langs as (select source, string_agg(lang, ' < ' order by first) langs from (select source, lang, min(doc_id) first from documents where lang <> '' group by source, lang) group by source),
words as (select source, string_agg(word, ';' order by word) words from (select distinct source, unnest(string_split(lower(text), ' ')[1:3]) word from documents) group by source)
select d.source, count(*) members, max(n_chars) n_chars, langs, coalesce(arg_min(lang, doc_id) filter (where lang <> 'en' and lang <> ''), arg_min(lang, doc_id)) main, md5(words) words from documents d join langs using (source) join words using (source) group by d.source, langs, words
""")
def merged_sources(spark, sf_dir):
    """All documents of a source as one row, though one source has a third of them: languages in order of their first document, the first one that isn't English, and every word that a document begins with."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars", F.col("lang").alias("langs"), F.col("lang").alias("main"), F.slice(F.split(F.lower("text"), " "), 1, 3).alias("words"))
    merged = relational.merge_groups(docs, "source", "doc_id", unions=["words"], maxima=["n_chars"], joined={"langs": " < "}, firsts={"main": "en"})
    return merged.select("source", "members", "n_chars", "langs", "main", F.md5(F.array_join("words", ";").cast("binary")).alias("words"))


@bound("""
with ranked as (select l_suppkey, l_orderkey, l_linenumber, row_number() over (partition by l_suppkey order by l_extendedprice desc, l_orderkey, l_linenumber) n from lineitem)
select l_suppkey, l_orderkey, l_linenumber, (select count(*) from ranked) seen, (select count(*) from ranked where n <= 25) "kept", (select count(*) from ranked where n > 25) dropped from ranked where n <= 25
""")
def observed_budget_lines(spark, sf_dir):
    """The 25 largest lines of each supplier, and how many that leaves out, observed while they are chosen."""
    lines = _table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", (-F.col("l_extendedprice")).alias("price"))
    chosen, audit = control.observed_budget(lines, "l_suppkey", ["price", "l_orderkey", "l_linenumber"], 25)
    return chosen.select("l_suppkey", "l_orderkey", "l_linenumber").join(F.broadcast(audit))  # one row


@bound("""
with answered as (select page_id, case when page_id % 10 = 0 then 'curated' when page_id % 2 = 0 and page_id % 4 <> 0 then 'cache-0' when page_id % 2 <> 0 and page_id % 3 = 0 then 'cache-1' when page_id % 2 <> 0 and page_id % 7 = 0 then 'cache-2' else 'live' end layer from pages)
select 'page ' || page_id company, layer, 0 seq, 'Firm ' || chr(cast(65 + page_id % 26 as int)) || ' ' || layer || ' Components' as name from answered
""")
def layered_pages(spark, sf_dir):
    """Stored versions of each page's record, and the one that counts: curated, else the newest version, else live if that is empty, else the first older version with rows, else live."""
    pages = _table(spark, sf_dir, "pages").select("page_id")
    folder, k = shared_path(spark, "layers"), F.col("page_id")
    company = F.concat(F.lit("page "), k.cast("string"))

    def stored(layer, rows, empty=F.lit(False)):
        record = F.to_json(F.array(F.struct(F.concat(F.lit("Firm "), F.char(65 + k % 26), F.lit(f" {layer} Components")).alias("name"))))
        rows.select(company.alias("company"), F.when(empty, "[]").otherwise(record).alias("payload")).write.parquet(f"{folder}/{layer}")

    stored("curated", pages.filter(k % 10 == 0))
    stored("cache-0", pages.filter(k % 2 == 0), empty=k % 4 == 0)
    stored("cache-1", pages.filter(k % 3 == 0))
    stored("cache-2", pages.filter(k % 7 == 0))
    stored("live", pages)
    return discovery.layered_files(tables.versioned_files(spark, folder)).select("company", "layer", "seq", "name")
