"""The registered queries of the corpus operators: whole tables, production parameters.

ORACLES has the DuckDB SQL of those that SQL can express; tests/llm hold the others against
brute-force versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from supplymesh.llm import bpe, centroids, chunks, domtree, ecoc, grammar, jaccard, ogg, packing, toxicity, urlrank, whitening, zipwarc
from supplymesh.llm.common import table


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_host_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlrank.judge(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op2_chunk_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.compare_neighbours(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_html_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = domtree.extract_column(table(spark, sf_dir, "pages").select("page_id", "url", "html"), domtree.trained())
    return read.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op4_ogg(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    read = ogg.read_column(ogg.store_column(docs).drop("text"), with_payload=False)
    return read.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.learn(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    judged = toxicity.detect(docs.withColumn("held_out", toxicity.held_out()), model)
    return judged.select("doc_id", "held_out", "score", "predicted", "evidence", F.size("passages").alias("n_passages"))


def op6_zip_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zipwarc.round_trip(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer("byte_bpe_50k.json"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = ecoc.learn(docs, ~ecoc.held_out())
    return ecoc.identify(docs.select("doc_id", ecoc.held_out().alias("held_out"), "text"), model).drop("text")


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.joined(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.encode_column(docs, "text", tokenizer("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, "ids", "decoded").drop("text")
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op11_grammar_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scanned = grammar.scan(docs, grammar.learn(docs)).select("doc_id", "spans")
    of = lambda *kinds: F.filter("spans", lambda s: s["kind"].isin(*kinds))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in grammar.KINDS]
    base = F.sha2(joined(of(*grammar.KINDS[:3])).cast("binary"), 256)
    return scanned.select("doc_id", *counts, base.alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return whitening.whitened_components(vectors).withColumn("deviation", F.col("deviation").cast("long"))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = centroids.cluster(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    longs = [F.col(c).cast("long").alias(c) for c in ("cluster_inertia", "inertia")]
    return found.select("vec_id", "cluster", "distance", *longs, F.sha2(F.array_join("centroid", ",").cast("binary"), 256).alias("centroid_sha256"))


QUERIES = {
    "op1_host_rank": op1_host_rank,
    "op2_chunk_fingerprints": op2_chunk_fingerprints,
    "op3_html_tree": op3_html_tree,
    "op4_ogg": op4_ogg,
    "op5_toxicity": op5_toxicity,
    "op6_zip_warc": op6_zip_warc,
    "op7_packing": op7_packing,
    "op8_language_id": op8_language_id,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_bpe": op10_bpe,
    "op11_grammar_secrets": op11_grammar_secrets,
    "op12_whitening": op12_whitening,
    "op13_centroids": op13_centroids,
}


def _lloyd_sql(k: int = 40, rounds: int = 5, dims: int = 64) -> str:
    """Centroid clustering in SQL: vectors and centroids in long form, one pair of tables for each round."""
    steps = [f"""
with good as (select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) q from embeddings
  where len(embedding) = {dims} and len(list_filter(embedding, lambda x: isfinite(x))) = {dims}),
numbered as materialized (select *, row_number() over () r from good),
v as materialized (select r, unnest(range(1, {dims + 1})) d, unnest(q) q from numbered),
c0 as materialized (select c, unnest(range(1, {dims + 1})) d, unnest(q) q from (select q, row_number() over (order by sha256('2:' || vec_id), q) - 1 c from good) where c < {k})"""]
    for i in range(rounds + 1):
        steps.append(f"a{i} as materialized (select r, arg_min(c, (x, c)) c, min(x) x from (select r, c, sum((v.q - c{i}.q) * (v.q - c{i}.q))::bigint x from v join c{i} using (d) group by r, c) group by r)")
        if i < rounds:
            steps.append(f"m{i} as (select a{i}.c, d, cast(floor(cast(sum(q) as double) / count(*)) as bigint) q from v join a{i} using (r) group by a{i}.c, d)")
            steps.append(f"c{i + 1} as materialized (select c, d, coalesce(m{i}.q, c{i}.q) q from c{i} left join m{i} using (c, d))")
    steps.append(f"digests as (select c, sha256(string_agg(cast(q as varchar), ',' order by d)) s from c{rounds} group by c)")
    return ",\n".join(steps) + f"""
select vec_id, cast(c as int) "cluster", x distance, cast(sum(x) over (partition by c) as bigint) cluster_inertia, cast(sum(x) over () as bigint) inertia, s centroid_sha256
from a{rounds} join numbered using (r) join digests using (c)"""


#: DuckDB SQL of the queries that it can express; learned, iterative and encoded results can't be.
ORACLES: dict[str, str] = {
    "op6_zip_warc": """
with p as (select page_id, octet_length(encode(coalesce(html, ''))) n, sha256(coalesce(html, '')) d from pages),
f as (select *, case when n >= 100 then min(page_id) over (partition by d) end first from p)
select page_id, n payload_bytes, d payload_digest, case when first is distinct from page_id and first is not null then 'revisit' else 'response' end record_type, case when first <> page_id then first end refers_to from f
""",
    "op9_jaccard_join": """
with recursive w as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x09-\\x0D\\x20]+'), lambda x: x <> '') w from documents),
s as (select distinct doc_id, unnest(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) when len(w) > 0 then [array_to_string(w, ' ') || ' ' || len(w)] else [] end) s from w),
n as (select doc_id, count(s.s) n from w left join s using (doc_id) group by doc_id),
shared as (select a.doc_id a, b.doc_id b, count(*) i from s a join s b on a.s = b.s and a.doc_id < b.doc_id group by a.doc_id, b.doc_id),
links as (select a, b from shared join n x on x.doc_id = a join n y on y.doc_id = b where 100 * i >= 80 * (x.n + y.n - i)),
linked as materialized (select a, b from links union select b, a from links),
reach as (select doc_id, doc_id r from n union select reach.doc_id, b from reach join linked on linked.a = reach.r)
select doc_id, min(n) n_shingles, min(r) component_id from reach join n using (doc_id) group by doc_id
""",
    "op13_centroids": _lloyd_sql(),
}
