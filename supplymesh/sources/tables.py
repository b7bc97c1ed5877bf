"""Sources and sinks: profiles, pages, feeds, caches, history, graphs."""

from __future__ import annotations

from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from supplymesh.functions.names import compact_key, initials, slug

PROFILE = "name string, industry string, headquarters string, description string, website string"
HISTORY = "company string, timestamp string, mode string, health_score double, health_status string, supplier_count long, risk_count long, suppliers array<string>"


def profile_path(folder: str, company: str) -> str:
    """Where a company's profile lies: lower case, words joined by underscores."""
    import re

    return f"{folder}/{re.sub(r'\s+', '_', re.sub(r'[^\w\s]', '', company.lower()))}_info.json"


def read_profiles(spark: SparkSession, path: str) -> DataFrame:
    """Profiles of JSON files; files that aren't objects give none."""
    return spark.read.schema(PROFILE).json(path, multiLine=True, mode="DROPMALFORMED").withColumn("company_key", slug(F.col("name")))


def versioned_files(spark: SparkSession, folder: str) -> DataFrame:
    """(company, layer, payload) of Parquet tables in folders named by their layers; one scan, the layer is taken from each row's file."""
    read = spark.read.schema("company string, payload string").parquet(f"{folder}/*")
    return read.select("company", F.regexp_extract("_metadata.file_path", r"/([^/]+)/[^/]+$", 1).alias("layer"), "payload")


def write_profiles(profiles: DataFrame, path: str) -> None:
    profiles.withColumn("company_key", slug(F.col("name"))).write.mode("append").partitionBy("company_key").json(path)


def title_fits(title: Column, company: Column) -> Column:
    """Whether a page title is that of a company: one has the other, they share a word of more than six letters, or one has the other's initials."""
    t, c = F.lower(title), F.lower(company)
    long = lambda x: F.filter(F.split(compact_key(x), " "), lambda w: F.length(w) > 6)
    return F.contains(t, c) | F.contains(c, t) | F.arrays_overlap(long(title), long(company)) | (F.upper(company) == initials(title))


class _Infobox(HTMLParser):
    """The first paragraph of over 60 characters outside tables, and the rows of the first infobox."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows: list[tuple[str, str]] = []
        self.paragraph = ""
        self.tables, self.box, self.cell, self.sup = 0, 0, None, 0
        self.text: list[str] = []
        self.label = ""
        self.inside = False

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.tables += 1
            if not self.box and "infobox" in (dict(attrs).get("class") or ""):
                self.box = self.tables
        elif tag in ("th", "td") and self.box:
            self.cell, self.text = tag, []
        elif tag == "p" and not self.tables and not self.paragraph:
            self.inside, self.text = True, []
        elif tag == "sup":
            self.sup += 1
        elif tag == "br":
            self.text.append(" ")

    def handle_endtag(self, tag):
        if tag == "table":
            if self.box == self.tables:
                self.box = 0
            self.tables = max(0, self.tables - 1)
        elif tag == self.cell:
            said = " ".join("".join(self.text).split())
            if tag == "th":
                self.label = said
            else:
                self.rows.append((self.label, said))
            self.cell = None
        elif tag == "p" and self.inside:
            said = " ".join("".join(self.text).split())
            self.inside = False
            if len(said) > 60:
                self.paragraph = said
        elif tag == "sup":
            self.sup = max(0, self.sup - 1)

    def handle_data(self, data):
        if not self.sup and (self.cell or self.inside):
            self.text.append(data)


def parse_profile(page: str | None) -> dict[str, str | None]:
    """Description, industry, headquarters and website of a company's page; what isn't there is "Not found"."""
    p = _Infobox()
    p.feed(page or "")
    find = lambda word: next((v for k, v in p.rows if word in k.lower()), None)
    return {"description": p.paragraph or "Not found", "industry": find("industry") or "Not found", "headquarters": find("headquarters") or "Not found", "website": find("website")}


def profiles_of_pages(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages with a struct column profile parsed from HTML, in Arrow batches: Spark has no HTML parser."""

    @F.pandas_udf("description string, industry string, headquarters string, website string")
    def parsed(x):
        import pandas as pd

        return pd.DataFrame([parse_profile(v) for v in x], columns=["description", "industry", "headquarters", "website"])

    return pages.withColumn("profile", parsed(F.col(html)))


def feed_items(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """Items (supplier_name, feed, seq, at, title, snippet, link, pub_date, item) of RSS payloads, each item's fields its own; a title counts once for
    a supplier and feed. A missing description is empty, items without a title and payloads that aren't XML give none."""
    from pyspark.sql import Window as W

    item = "struct<title:string,description:string,link:string,pubDate:string>"
    read = F.from_xml(F.col(payload), f"channel struct<item:array<{item}>>", {"mode": "PERMISSIVE"})
    each = payloads.select("supplier_name", "feed", "seq", F.posexplode(read["channel"]["item"]).alias("at", "i"))
    each = each.select("supplier_name", "feed", "seq", "at", F.col("i.title").alias("title"), F.coalesce("i.description", F.lit("")).alias("snippet"), F.col("i.link").alias("link"), F.col("i.pubDate").alias("pub_date")).filter("title <> ''")
    first = each.withColumn("n", F.row_number().over(W.partitionBy("supplier_name", "feed", "title").orderBy("seq", "at"))).filter("n = 1").drop("n")
    order = W.partitionBy("supplier_name", "feed").orderBy("seq", "at")
    return first.withColumn("item", F.row_number().over(order) - 1)


def append_history(runs: DataFrame, path: str) -> None:
    """Runs (HISTORY), added to those that are there; nothing is read or rewritten."""
    runs.write.mode("append").partitionBy("company").parquet(path)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """Runs of Parquet tables, or of JSON files with a list of runs each; a missing mode is "llm"."""
    if path.endswith(".json"):
        raw = spark.read.schema("company string, runs array<struct<timestamp:string,mode:string,health_score:double,health_status:string,supplier_count:long,risk_count:long,suppliers:array<string>>>").json(path, multiLine=True)
        runs = raw.select("company", F.posexplode("runs").alias("seq", "r")).select("company", "seq", "r.*")
    else:
        runs = spark.read.parquet(path)
    return runs.withColumn("mode", F.coalesce("mode", F.lit("llm")))


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    nodes.write.mode("overwrite").json(f"{path}/nodes")
    edges.write.mode("overwrite").json(f"{path}/edges")


def lookup_json(table: DataFrame, key: str, value: str) -> DataFrame:
    """The rows of a key as JSON strings."""
    return table.filter(compact_key(F.col(key)) == compact_key(F.lit(value))).select(F.to_json(F.struct("*")).alias("json"))


def transcript(conversations: DataFrame) -> DataFrame:
    """The turns of each conversation as one text, in order."""
    turns = conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    return turns.select("conv_id", F.array_join(F.transform("t", lambda r: F.concat(r["role"], F.lit(": "), r["text"])), "\n").alias("transcript"))
