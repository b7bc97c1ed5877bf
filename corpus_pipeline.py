"""From raw documents to packed training sequences: toxicity, language, near copies, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``docs`` has the columns of
``documents``, and all stages but the last return these. A stage sees only what its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from supplymesh.llm import ecoc, jaccard, packing, toxicity
from supplymesh.llm.common import stored, table
from supplymesh.llm.queries import tokenizer


def _row(docs: DataFrame) -> Column:
    """All columns of a document in one, so that none can have the name of another that a stage needs."""
    return F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the ones predicted toxic."""
    model = toxicity.learn(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return toxicity.detect(docs.select(_row(docs), "text"), model).filter("predicted = 0").select("row.*")


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told: those without a letter, or whose score is ambiguous, go. Columns are kept as they are."""
    model = ecoc.learn(docs, ~ecoc.held_out())
    names = ["lang_pred", "score", "ambiguous"]
    judged = ecoc.identify(docs.select(_row(docs), "text"), model)
    return judged.filter(~F.col("ambiguous") & (F.col("lang_pred") != ecoc.UNKNOWN)).drop(*names).select("row.*")


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the document with the least doc_id, or one where no row of the group has an id; of rows that repeat its id and text, one.
    Texts are judged apart where they share an id. Documents without words stay."""
    key = ["id", "nameless", "digest"]  # texts are shuffled once, by these
    named = [F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("nameless")]
    kept = jaccard.kept(docs.select("doc_id", "text")).select(*named, "digest")
    wordless = ~F.coalesce(F.col("text").cast("string"), F.lit("")).rlike(r"[^\x09-\x0D ]")
    rows = docs.select(_row(docs), *named, jaccard.digest("text").alias("digest"), wordless.alias("wordless"))
    alone = F.col("nameless") & F.col("wordless")
    once = rows.filter(~alone).dropDuplicates(key).join(kept, key, "left_semi")
    return once.select("row.*").unionByName(rows.filter(alone).select("row.*"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences."""
    return packing.pack(docs, tokenizer("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("language_id", drop_unknown_language),
    ("jaccard_join", keep_one_of_near_copies),
    ("packing", pack_sequences),
]

#: Learned scores and packing can't be said in SQL; tests/llm hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents table, each one's result written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
