"""Byte-level BPE by a rank queue in a hierarchical bitmap.

Each pre-token is a doubly linked list of byte positions. A pair that the vocabulary can merge
waits in the bucket of its merge rank. A bitmap of three levels of 64-bit words marks the ranks
whose buckets hold something, so the next rank is three find-first-set steps away however many
ranks there are. A merge only changes its two neighbouring pairs; their older entries stay in
their buckets and are skipped when they come up, as their rank no longer holds. The cost of a
pre-token of n bytes is O(n log n) at worst, where rescanning it for each merge takes O(n^2).
"""

from __future__ import annotations

import base64
import struct
from array import array
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from supplymesh.llm.common import lean, prepare, schema_with
from supplymesh.llm.pretokens import CHARS, ChunkMemory, Generations

#: Pre-tokens and chunks that a worker remembers in a generation; packing of so many ids.
PIECES, CHUNKS = 300_000, 1_200_000
_PACK = [struct.Struct(f"<{n}I").pack for n in range(CHARS)]


class RankQueue:
    """A priority queue of (rank, position): the smallest rank first, then the smallest position."""

    def __init__(self, ranks: int):
        n = max(1, ranks + 63 >> 6)
        self.low = [0] * n
        self.mid = [0] * (n + 63 >> 6)
        self.top = 0
        self.buckets: dict[int, list[int]] = {}

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is None:
            self.buckets[rank] = [position]
            w = rank >> 6
            if not self.low[w]:
                v = w >> 6
                if not self.mid[v]:
                    self.top |= 1 << v
                self.mid[v] |= 1 << (w & 63)
            self.low[w] |= 1 << (rank & 63)
        else:
            heappush(bucket, position)

    def pop(self) -> tuple[int, int] | None:
        """The first entry, taken out; None when the queue is empty."""
        top = self.top
        if not top:
            return None
        v = (top & -top).bit_length() - 1
        x = self.mid[v]
        w = (v << 6) + (x & -x).bit_length() - 1
        x = self.low[w]
        rank = (w << 6) + (x & -x).bit_length() - 1
        bucket = self.buckets[rank]
        position = heappop(bucket)
        if not bucket:
            del self.buckets[rank]
            self.low[w] = x = x & (x - 1)
            if not x:
                self.mid[v] &= ~(1 << (w & 63))
                if not self.mid[v]:
                    self.top &= ~(1 << v)
        return rank, position


class BytePairEncoder:
    """Ids of byte strings by the merge ranks of a vocabulary: {token bytes: rank}, each single byte included."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"the vocabulary lacks single bytes, {missing[0]} first")
        self.ranks = ranks
        self.split = regex.compile(pattern).findall
        self.queue = RankQueue(max(ranks.values()) + 1)
        self.memory: Generations[str, bytes] = Generations(PIECES)
        self.tokens: list[bytes | None] = [None] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token

    @classmethod
    def load(cls, path: str, pattern: str) -> BytePairEncoder:
        """From a file of lines: base64 of a token, a space, its rank."""
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}, pattern)

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one pre-token."""
        ranks, known = self.ranks, self.ranks.get(piece)
        if known is not None:
            return [known]
        n = len(piece)
        if not n:
            return []
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        waits = [-1] * n  # the rank that the pair starting here waits for; -1: none
        push, pop, get = self.queue.push, self.queue.pop, ranks.get
        for i in range(n - 1):
            r = get(piece[i : i + 2])
            if r is not None:
                waits[i] = r
                push(r, i)
        while (head := pop()) is not None:
            r, i = head
            if waits[i] != r:
                continue  # stale
            j = after[i]
            k = after[j]
            waits[j] = -1
            after[i] = k
            if k < n:
                before[k] = i
                s = get(piece[i : after[k]])
                if s is None:
                    waits[i] = -1
                else:
                    waits[i] = s
                    push(s, i)
            else:
                waits[i] = -1
            h = before[i]
            if h >= 0:
                s = get(piece[h:k])
                if s is None:
                    waits[h] = -1
                elif s != waits[h]:
                    waits[h] = s
                    push(s, h)
        ids, i = [], 0
        while i < n:
            ids.append(ranks[piece[i : after[i]]])
            i = after[i]
        return ids

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_many([text])[0], "<u4").tolist()

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers; pre-tokens are merged once while remembered."""
        pieces = [self.split(t) for t in texts]
        missing = self.memory.recall(p for own in pieces for p in own if len(p) <= CHARS)
        known, merge = self.memory.young, self.merge
        for p in missing:
            ids = merge(p.encode("utf-8", "surrogatepass"))
            known[p] = _PACK[len(ids)](*ids) if len(ids) < len(_PACK) else array("I", ids).tobytes()
        return [b"".join([known[p] if len(p) <= CHARS else array("I", merge(p.encode("utf-8", "surrogatepass"))).tobytes() for p in own]) for own in pieces]

    def decode(self, ids: bytes) -> bytes:
        """The bytes that ids stand for; an id outside the vocabulary is an error."""
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


#: Encoders of this worker by vocabulary and pattern: loaded once, with what they remember of chunks.
_LOADED: dict[tuple[str, str], tuple[BytePairEncoder, ChunkMemory]] = {}


def loaded(path: str, pattern: str) -> tuple[BytePairEncoder, ChunkMemory]:
    if (path, pattern) not in _LOADED:
        own = BytePairEncoder.load(path, pattern)
        _LOADED[path, pattern] = own, ChunkMemory(own.encode_many, CHUNKS)
    return _LOADED[path, pattern]


def encode_column(df: DataFrame, text: str, path: str, pattern: str, ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """df with the ids of its text column: binary, little-endian unsigned 32-bit; and, if named, what they decode to: binary.

    ``path`` is a rank file, ``pattern`` splits texts before merging. Null texts count as empty; an empty text has
    no ids. Other columns pass through, except one that has the name of a new column, which gives way. No shuffle.
    """
    prepare(df.sparkSession)
    new = [ids, *([decoded] if decoded else [])]
    source = f"__text_{text}"
    kept = df.drop(*(c for c in new if c != text))
    kept = kept.withColumn(source, F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")))
    kept = kept.drop(text) if text in new else kept

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, memory = loaded(path, pattern)
        for batch in batches:
            at = batch.schema.get_field_index(source)
            found = memory.encode(batch.column(at).to_pylist())
            columns = [c for i, c in enumerate(batch.columns) if i != at] + [pa.array(found, pa.binary())]
            if decoded:
                columns.append(pa.array([encoder.decode(x) for x in found], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, names=[n for i, n in enumerate(batch.schema.names) if i != at] + new)

    return kept.mapInArrow(lean(run), schema_with(kept.drop(source), *((name, "binary") for name in new)))


def decode_column(df: DataFrame, ids: str, path: str, pattern: str, decoded: str = "decoded") -> DataFrame:
    """df with the bytes that its column of ids (binary, little-endian unsigned 32-bit; null: empty) stands for."""
    prepare(df.sparkSession)
    kept = df.drop(decoded) if decoded != ids else df

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, _ = loaded(path, pattern)
        for batch in batches:
            found = [encoder.decode(x or b"") for x in batch.column(batch.schema.get_field_index(ids)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.binary())], names=[*batch.schema.names, decoded])

    return kept.mapInArrow(lean(run), schema_with(kept, (decoded, "binary")))
