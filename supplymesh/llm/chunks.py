"""Document fingerprints by content-defined chunking.

A gear hash runs over a text's UTF-8 bytes: each byte shifts the hash left by one bit and adds that
byte's entry of a fixed table, so the hash depends on the last 32 bytes alone. A chunk ends where
masked bits of the hash are all zero. Boundaries are normalised: before the usual chunk size more
bits must be zero than after it, which pulls sizes towards the usual one; no chunk is shorter than
the least size or longer than the greatest. Since boundaries depend on content, an insertion moves
them only nearby. The fingerprint is the set of chunk digests with their lengths, and likeness is
the share of a fingerprint's length whose chunks the other one has: containment.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from supplymesh.llm.common import checkpointed, lean, prepare, schema_with, spare

#: Least, usual and greatest bytes in a chunk; zero bits asked for before the usual size and after it.
LEAST, USUAL, GREATEST, BITS_BEFORE, BITS_AFTER = 24, 64, 256, 7, 4
#: The gear table: the first four bytes of SHA-256 of each byte value.
GEAR = np.array([int.from_bytes(hashlib.sha256(bytes([b])).digest()[:4], "little") for b in range(256)], "<u4")
#: Bytes of a fingerprint's entry: 5 of digest, 1 of length less one.
ENTRY = 6


def gear_hashes(data: bytes) -> np.ndarray:
    """The gear hash at each byte: the sum over the last 32 bytes of table[byte] << age, by doubling windows."""
    h = GEAR[np.frombuffer(data, "u1")]
    step = 1
    while step < min(32, len(h)):
        older = h[:-step] << np.uint32(step)
        h[step:] += older
        step *= 2
    return h


def boundaries(data: bytes) -> list[int]:
    """Where chunks end, the end of data included."""
    n = len(data)
    if n <= LEAST:
        return [n] if n else []
    h = gear_hashes(data)
    loose = np.flatnonzero((h >> np.uint32(32 - BITS_AFTER)) == 0)
    strict = (h[loose] >> np.uint32(32 - BITS_BEFORE)) == 0
    ends, start, i = [], 0, 0
    at, hard = (loose + 1).tolist(), strict.tolist()
    count = len(at)
    while start < n:
        low, mid, high = start + LEAST, start + USUAL, start + GREATEST
        if high > n:
            high = n
        end = high
        while i < count and at[i] < low:
            i += 1
        while i < count:
            p = at[i]
            if p > high:
                break
            i += 1
            if p >= mid or hard[i - 1]:
                end = p
                break
        ends.append(end)
        start = end
    return ends


def chunk_set(data: bytes) -> dict[bytes, int]:
    """Entry of each distinct chunk (digest and length) with its length."""
    out: dict[bytes, int] = {}
    start = 0
    digest = xxhash.xxh3_64_digest
    for end in boundaries(data):
        out[digest(data[start:end])[:5] + bytes([end - start - 1])] = end - start
        start = end
    return out


def fingerprint(chunks: dict[bytes, int]) -> str:
    """A chunk set as text: its sorted entries in base64; empty for an empty document."""
    return base64.b64encode(b"".join(sorted(chunks))).decode()


def parse(text: str) -> dict[bytes, int]:
    raw = base64.b64decode(text)
    return {raw[i : i + ENTRY]: raw[i + ENTRY - 1] + 1 for i in range(0, len(raw), ENTRY)}


def containment(own: dict[bytes, int], other: dict[bytes, int]) -> float:
    """The share of own's length in chunks that other has. Of an empty one: 1 if both are empty, else 0."""
    if not own:
        return 1.0 if not other else 0.0
    return sum(own[k] for k in own.keys() & other.keys()) / sum(own.values())


def utf8(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def fingerprint_column(df: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """df with a fingerprint of its text column. Null counts as empty, with an empty fingerprint; equal texts, equal values.
    Other columns pass through, except one named ``out``, which gives way. Row by row, no shuffle."""
    prepare(df.sparkSession)
    source = spare(df, "__text")
    kept = df.withColumn(source, F.col(f"`{text}`").cast("string")).drop(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(source)
            found = [fingerprint(chunk_set(utf8(t or ""))) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([c for i, c in enumerate(batch.columns) if i != at] + [pa.array(found, pa.string())], names=[n for i, n in enumerate(batch.schema.names) if i != at] + [out])

    return kept.mapInArrow(lean(run), schema_with(kept.drop(source), (out, "string")))


def spliced(text: str, following: str) -> str:
    """text with its last floor(n / 2) code points replaced by as many first ones of the following text, or all it has."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


# --- every document with the one that follows it -------------------------------------------------

#: Characters of text in a bucket of neighbouring documents, about; buckets at most, however large the table is.
BUCKET_CHARS, BUCKETS = 4 << 20, 1 << 16
#: A text is hot under its key with more than this part of all rows. Copies of a hot row made in one task.
HOT, COPIES = 1000, 4096
#: Characters by which texts of one key are dealt.
BEGIN = 32
OWN, NEIGHBOUR = 0, 1


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


@dataclass
class _Seen:
    key: int | None
    text: str
    chunks: dict[bytes, int]


def compare_neighbours(docs: DataFrame, key: str = "doc_id", text: str = "text", bucket_chars: int = BUCKET_CHARS) -> DataFrame:
    """Each document with its edited text and its neighbour, in ascending order of the key (after the last: the first).

    Returns the key as ``doc_id``, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. Null texts
    are empty; null keys come first; rows with equal keys follow each other in order of their texts. An empty table gives none.

    Pairs of key and beginning of the text are range-partitioned; the least pair of each range bounds a bucket, and the driver gets these
    bounds, BUCKETS at most. Each row then goes to its bucket, and the first rows of a bucket also to the bucket before it, so that the texts are
    shuffled once, every bucket holds all it needs and is a task of its own, and is streamed in order through memory that holds two texts.
    A row (a key and a 64-bit hash of the text) that is repeated over a thousandth of all rows, of which there can't be more than a thousand, goes
    once: all its copies but the last are followed by a copy.
    """
    spark = docs.sparkSession
    prepare(spark)
    base = docs.select(F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(-(1 << 63))).alias("k"), F.col(f"`{key}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    begin = F.substring("text", 1, BEGIN)
    groups = checkpointed(base.groupBy("k", "h").agg(F.count("*").alias("n"), F.sum(F.length("text").cast("long")).alias("chars"), F.min(begin).alias("b")))
    rows, size = groups.agg(F.sum("n"), F.sum("chars")).first()
    if not rows:
        return spark.createDataFrame([], RESULT)
    hot = checkpointed(groups.filter((F.col("n") > 1) & (F.col("n") > rows / HOT)).select("k", "h", "n"))  # at most HOT rows
    buckets = min(BUCKETS, max(1, -(-size // bucket_chars)))
    ranges = groups.select("k", "b").repartitionByRange(buckets, "k", "b").groupBy(F.spark_partition_id()).agg(F.min(F.struct("k", "b")).alias("least"))
    bounds = sorted({(r.k, r.b) for r in ranges.select("least.*").collect()})
    buckets, shared = len(bounds), spark.sparkContext.broadcast(bounds)

    @F.pandas_udf("bucket int, first boolean")
    def placed(k, b):
        import pandas as pd

        keys, k = np.array([x for x, _ in shared.value], "i8"), k.to_numpy()
        low, high = np.searchsorted(keys, k, "left"), np.searchsorted(keys, k, "right")
        at, first = low - 1, np.zeros(len(k), "?")
        for i in np.flatnonzero(low < high).tolist():  # rows whose key a bound has
            own = int(k[i]), b.iat[i]
            at[i] = bisect_right(shared.value, own) - 1
            first[i] = shared.value[at[i]] == own
        return pd.DataFrame({"bucket": at.astype("i4"), "first": first})

    if several := hot.count():
        once = base.join(F.broadcast(hot), ["k", "h"]).groupBy("k", "h", "n").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"))
        base = base.join(F.broadcast(hot), ["k", "h"], "left_anti").unionByName(once.drop("n"))
    before = F.pmod(F.col("p.bucket") - 1, F.lit(buckets)).alias("bucket")
    kinds = F.when(F.col("p.first"), F.array(F.struct(F.col("p.bucket").alias("bucket"), F.lit(OWN).alias("kind")), F.struct(before, F.lit(NEIGHBOUR).alias("kind")))).otherwise(F.array(F.struct(F.col("p.bucket").alias("bucket"), F.lit(OWN).alias("kind"))))
    dealt = base.withColumn("p", placed("k", begin)).select(F.explode(kinds).alias("to"), "k", "doc_id", "text").select("to.bucket", "to.kind", "k", "doc_id", "text")
    dealt = dealt.repartitionById(buckets, "bucket").sortWithinPartitions("kind", "k", "text").select("doc_id", "text", "kind")

    def result(own: _Seen, following: _Seen) -> tuple:
        edited = utf8(spliced(own.text, following.text))
        chunks = chunk_set(edited)
        return (own.key, len(own.text), hashlib.sha256(edited).hexdigest(), fingerprint(own.chunks), fingerprint(chunks), containment(own.chunks, chunks), containment(own.chunks, following.chunks))

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 7, kinds)], names=[x.split()[0] for x in RESULT.split(", ")])

    def seen(batch: pa.RecordBatch) -> Iterator[_Seen]:
        for doc_id, body in zip(*(c.to_pylist() for c in batch.columns[:2])):
            yield _Seen(doc_id, body, chunk_set(utf8(body)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: _Seen | None = None
        for batch in batches:
            rows: list[tuple] = []
            for kind, now in zip(batch.column(2).to_pylist(), seen(batch)):
                if waiting is not None:
                    rows.append(result(waiting, now))
                elif kind == NEIGHBOUR:
                    break  # the bucket's last document has its neighbour already
                waiting = now if kind == OWN else None
            yield batch_of(rows)

    out = dealt.mapInArrow(lean(run), RESULT)
    if not several:
        return out

    names = [x.split()[0] for x in RESULT.split(", ")]

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = batch_of([result(x, x) for x in seen(batch)])
            yield pa.RecordBatch.from_arrays([*made.columns, batch.column(2)], names=[*names, "n"])

    made = once.select("doc_id", "text", "n").mapInArrow(lean(again), f"{RESULT}, n long")
    parts = made.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 2) / COPIES))).alias("part")).repartition("part", "edited_sha256")
    return out.unionByName(parts.select(*names, F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(COPIES).cast("long"), F.col("n") - 1 - F.col("part") * COPIES))).alias("copy")).drop("copy"))
