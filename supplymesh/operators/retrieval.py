"""Documents of a run, their vectors, and evidence found by similarity."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from supplymesh.functions.names import slug
from supplymesh.operators.vector import top_similar

WIDTH, CHUNKS, CHARS = 256, 3, 1000


def documents(suppliers: DataFrame, risks: DataFrame, reports: DataFrame) -> DataFrame:
    """(content, kind, name) of suppliers (name, location, products), risks (supplier_name, severity, reasoning) and reports (company, summary)."""
    s = suppliers.select(F.concat(F.lit("Supplier: "), "name", F.lit(". Location: "), F.coalesce("location", F.lit("")), F.lit(". Products: "), F.array_join("products", ", ")).alias("content"), F.lit("supplier").alias("kind"), "name")
    r = risks.select(F.concat(F.lit("Risk for "), "supplier_name", F.lit(" ("), "severity", F.lit("): "), "reasoning").alias("content"), F.lit("risk").alias("kind"), F.col("supplier_name").alias("name"))
    return s.unionByName(r).unionByName(reports.select(F.col("summary").alias("content"), F.lit("report").alias("kind"), F.col("company").alias("name")))


def hashed_embedding(text: str | None) -> list[float]:
    """A unit vector of hashed words and word pairs: the same on every machine, no model."""
    import re
    import zlib

    v = np.zeros(WIDTH)
    words = re.findall(r"\w+", (text or "").lower())
    for x in [*words, *(" ".join(p) for p in zip(words, words[1:]))]:
        h = zlib.crc32(x.encode())
        v[h % WIDTH] += 1 if h >> 16 & 1 else -1
    n = float(np.linalg.norm(v))
    return (v / n if n else v).tolist()


def embedded(df: DataFrame, text: str = "content", out: str = "embedding", embed=hashed_embedding) -> DataFrame:
    @F.pandas_udf("array<float>")
    def vectors(x):
        return x.map(embed)

    return df.withColumn(out, vectors(F.col(text)))


def enrich(suppliers: DataFrame, index: DataFrame, chunks: int = CHUNKS) -> DataFrame:
    """suppliers (name, evidence) with up to ``chunks`` indexed documents (doc_id, content, embedding) added as evidence, and how many as rag_count.

    A document is added only if its link and snippet aren't there; links are made of the document's beginning."""
    asked = embedded(suppliers.select(F.concat("name", F.lit(" supplier relationship evidence")).alias("content"), "name")).select(F.col("name").alias("doc_id"), "embedding")
    keyed = index.select(F.col("doc_id").cast("string").alias("doc_id"), "embedding")
    hits = top_similar(asked, keyed, chunks, "doc_id", "embedding").join(index.select(F.col("doc_id").cast("string").alias("id"), "content"), "id")
    title = F.concat(F.lit("Retrieved evidence for "), F.col("query_id"))
    item = F.struct(title.alias("title"), F.concat(F.lit("rag://"), slug(F.left("content", F.lit(40)), "-")).alias("link"), F.left("content", F.lit(CHARS)).alias("snippet"))
    found = hits.groupBy(F.col("query_id").alias("name")).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", item.alias("e")))), lambda x: x["e"]).alias("more"))
    key = lambda e: F.struct(e["link"].alias("l"), e["snippet"].alias("s"))
    new = F.filter(F.coalesce("more", F.array().cast("array<struct<title:string,link:string,snippet:string>>")), lambda e: ~F.exists("evidence", lambda x: key(x) == key(e)))
    return suppliers.join(found, "name", "left").withColumn("more", new).withColumn("rag_count", F.size("more")).withColumn("evidence", F.concat("evidence", "more")).drop("more")
