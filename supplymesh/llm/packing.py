"""Packing token sequences: linear grouping of the large pieces, best fit of the small ones.

Lengths lie between 1 and the capacity, so the counts of pieces by length describe the whole
problem in a table that doesn't grow with the corpus; the driver plans on that table alone.

1. Large lengths, in descending order, are cut into groups of equal cardinality; every piece of a
   group counts as long as the group's longest. Where there are no more lengths than groups, each
   length is a group, and nothing is rounded. Otherwise finer groups are tried too, and the plan
   with the fewest sequences is taken.
2. For these few sizes the plan finds configurations, sets of sizes that fill a sequence best, and
   uses each as often as its sizes last.
3. Actual pieces take the places of their group, longest first. Runs of sequences with the same
   actual lengths stay one entry of the plan.
4. Small lengths, longest first, go to the fullest sequence that still has room, in runs of equal
   room; new sequences open only if none has.

Pieces then find their place by their length and their number among the pieces of that length,
which is found by counting within salted parts, so no length has to meet in one task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from supplymesh.llm.common import lean, prepare, stored
from supplymesh.llm.pretokens import ChunkMemory

CAPACITY = 2048
#: Groups of large lengths; a length is large if more than this share of the capacity.
GROUPS, LARGE = 128, 1 / 8
#: Times finer groups that are tried besides.
FINER = 8
#: Pieces numbered in one salted part, about.
PART_ROWS = 4096


@dataclass
class Plan:
    """Runs of places. Piece i of a length, first <= i < first + count, goes to sequence
    bin + (i - first) // each, at fill + (i - first) % each * length."""

    length: np.ndarray
    first: np.ndarray
    count: np.ndarray
    bin: np.ndarray
    each: np.ndarray
    fill: np.ndarray
    sequences: int

    def places(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.length << 44 | self.first, length << 44 | number, "right") - 1
        k = number - self.first[at]
        if len(at) and ((self.length[at] != length) | (k >= self.count[at])).any():
            raise ValueError("a piece isn't in the plan")
        return self.bin[at] + k // self.each[at], self.fill[at] + k % self.each[at] * length


def _best_configuration(sizes: list[int], left: list[int], capacity: int) -> list[int]:
    """Indices of sizes, the largest one left first, that fill the capacity as far as possible; sizes are descending."""
    head = next(i for i, n in enumerate(left) if n)
    room = capacity - sizes[head]
    mask = (1 << room + 1) - 1
    reach, steps = 1, []
    for i in range(head, len(sizes)):
        for _ in range(min(left[i] - (i == head), room // sizes[i])):
            more = (reach | reach << sizes[i]) & mask
            if more == reach:
                break
            steps.append((i, reach))
            reach = more
        if reach >> room & 1:
            break
    fill, used = reach.bit_length() - 1, [head]
    for i, before in reversed(steps):
        if not before >> fill & 1:
            used.append(i)
            fill -= sizes[i]
    return sorted(used)


def plan(counts: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS, large: float = LARGE) -> Plan:
    """The places of all pieces, given how many there are of each length from 1 to the capacity."""
    if any(not 1 <= k <= capacity for k in counts):
        raise ValueError("lengths must be from 1 to the capacity")
    bigs = sorted((k for k, n in counts.items() if n and large * capacity < k < capacity), reverse=True)
    total = sum(counts[k] for k in bigs)
    if len(bigs) <= groups:
        return _grouped(counts, [[[k, 0, counts[k]]] for k in bigs], capacity, large)
    tried = [_grouped(counts, _equal_groups(counts, bigs, -(-total // g)), capacity, large) for g in (groups, FINER * groups)]
    return min(tried, key=lambda p: p.sequences)


def _equal_groups(counts: dict[int, int], lengths: list[int], share: int) -> list[list[list[int]]]:
    """Groups of so many pieces each, longest first, as runs [length, first number, count]."""
    runs: list[list[list[int]]] = []
    filled = share
    for k in lengths:
        first, n = 0, counts[k]
        while n:
            if filled == share:
                runs.append([])
                filled = 0
            now = min(n, share - filled)
            runs[-1].append([k, first, now])
            first, n, filled = first + now, n - now, filled + now
    return runs


def _grouped(counts: dict[int, int], runs: list[list[list[int]]], capacity: int, large: float) -> Plan:
    """The plan by these groups of large pieces, which are used up."""
    out: list[tuple[int, int, int, int, int, int]] = []
    room: dict[int, list[tuple[int, int]]] = {}  # room left: runs (first sequence, sequences)
    open_rooms = 0  # bit r: some run has room r
    bins = 0

    def give(r: int, begin: int, n: int) -> None:
        nonlocal open_rooms
        if r and n:
            room.setdefault(r, []).append((begin, n))
            open_rooms |= 1 << r

    if n := counts.get(capacity, 0):
        out.append((capacity, 0, n, 0, 1, 0))
        bins = n
    if runs:
        sizes = [g[0][0] for g in runs]
        left = [sum(x[2] for x in g) for g in runs]
        heads = [0] * len(runs)
        while any(left):
            used = _best_configuration(sizes, left, capacity)
            times = min(left[i] // used.count(i) for i in used)
            taken: list[list[list[int]]] = []
            for i in used:  # for each slot the next pieces of its group
                need, got = times, []
                while need:
                    run = runs[i][heads[i]]
                    now = min(need, run[2])
                    got.append([run[0], run[1], now])
                    run[1], run[2], need = run[1] + now, run[2] - now, need - now
                    if not run[2]:
                        heads[i] += 1
                left[i] -= times
                taken.append(got)
            done, at = 0, [0] * len(taken)
            while done < times:  # sequences whose slots have the same actual lengths
                n = min(t[a][2] for t, a in zip(taken, at))
                fill = 0
                for j, t in enumerate(taken):
                    x = t[at[j]]
                    out.append((x[0], x[1], n, bins + done, 1, fill))
                    fill += x[0]
                    x[1], x[2] = x[1] + n, x[2] - n
                    if not x[2]:
                        at[j] += 1
                give(capacity - fill, bins + done, n)
                done += n
            bins += times
    for k in sorted((k for k, n in counts.items() if n and k <= large * capacity), reverse=True):
        first, n = 0, counts[k]
        while n:
            fitting = open_rooms >> k
            if not fitting:
                new = -(-n // (capacity // k))
                give(capacity, bins, new)
                bins += new
                continue
            r = k + (fitting & -fitting).bit_length() - 1
            begin, c = room[r].pop()
            if not room[r]:
                open_rooms &= ~(1 << r)
            each = r // k
            whole = min(c, n // each)
            if whole:
                out.append((k, first, whole * each, begin, each, capacity - r))
                give(r - each * k, begin, whole)
                first, n = first + whole * each, n - whole * each
            if whole < c:
                rest = min(n, each - 1) if n < each else 0
                if rest:
                    out.append((k, first, rest, begin + whole, rest, capacity - r))
                    give(r - rest * k, begin + whole, 1)
                    first, n = first + rest, n - rest
                give(r, begin + whole + bool(rest), c - whole - bool(rest))
    columns = np.array(sorted(out), "i8").reshape(-1, 6).T
    return Plan(*columns, sequences=bins)


# --- over tables ---------------------------------------------------------------------------------

_TOKENIZERS: dict[str, ChunkMemory] = {}
#: The tokenizer as loaded, and its added tokens' contents.
_WHOLE: dict[str, tuple] = {}


def token_memory(path: str) -> ChunkMemory:
    """Ids by the tokenizers library, without special tokens, as little-endian unsigned 32-bit integers."""
    if path not in _TOKENIZERS:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        own = Tokenizer.from_file(path)
        own.encode_special_tokens = True  # chunks have no added token
        whole = Tokenizer.from_file(path)
        _WHOLE[path] = whole, [t.content for t in whole.get_added_tokens_decoder().values()]
        _TOKENIZERS[path] = ChunkMemory(lambda texts: encode_many(own, texts))
    return _TOKENIZERS[path]


#: Chunks that are encoded as lines of one text.
LINES = 200


def encode_many(tokenizer, texts: list[str]) -> list[bytes]:
    """The ids of each text. Texts whose white space is single line ends between other characters, or one leading space, are
    encoded many at once, as lines: such a line end is always a token of its own, and so is one between two such texts, by which their ids are told apart."""

    def ids(found: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in tokenizer.encode_batch_fast(found, add_special_tokens=False)]

    end = ids(["\n"])[0]
    out: list[bytes] = [b""] * len(texts)
    together, ends, alone = [], [], []
    for i, t in enumerate(texts):
        inner = t.count("\n")
        lines = t.split()
        if len(lines) == inner + 1 and len(t) - inner - (t[0] == " ") == sum(map(len, lines)) and t[-1] != "\n" and t[0] != "\n" and "\n\n" not in t and len(end) == 1:
            together.append(i)
            ends.append(inner)
        else:
            alone.append(i)
    for i, own in zip(alone, ids([texts[i] for i in alone])):
        out[i] = own.tobytes()
    for k in range(0, len(together), LINES * 50):
        group, inside = together[k : k + LINES * 50], ends[k : k + LINES * 50]
        own = ids(["\n".join([texts[i] for i in group[j : j + LINES]]) for j in range(0, len(group), LINES)])
        whole = np.concatenate([x for one in own for x in (one, end)])
        cuts = 4 * np.flatnonzero(whole == end[0])
        at = np.cumsum(np.array(inside) + 1) - 1
        if len(cuts) != at[-1] + 1:
            raise ValueError("the tokenizer doesn't keep line ends apart")
        raw, start = whole.tobytes(), 0
        for i, cut in zip(group, cuts[at].tolist()):
            out[i] = raw[start:cut]
            start = cut + 4
    return out


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def encoded(path: str, texts: list[str]) -> list[bytes]:
    """The ids of each text, as the tokenizer's file says: texts with an added token's content are encoded as a whole, which gives that token."""
    memory = token_memory(path)
    own, added = _WHOLE[path]
    out = memory.encode(texts)
    for i, t in enumerate(texts):
        if any(a in t for a in added):
            out[i] = np.array(own.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
    return out


def pieces(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of each document: its ids and the end id, cut if over the capacity into whole pieces, the first one shorter if need be."""
    prepare(docs.sparkSession)
    base = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            rows = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoded(path, batch.column(1).to_pylist())):
                ids += tail
                n = len(ids) // 4
                start, piece = 0, 0
                while start < n:
                    size = (n % capacity or capacity) if not piece else capacity
                    rows.append((doc_id, piece, start, size, zlib.crc32(ids[4 * start : 4 * (start + size)])))
                    start, piece = start + size, piece + 1
            columns = zip(*rows) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return base.mapInArrow(lean(run), PIECES)


def place(found: DataFrame, capacity: int = CAPACITY, groups: int = GROUPS, large: float = LARGE) -> DataFrame:
    """``found`` (columns of PIECES, read more than once) with ``sequence_id`` and ``offset``.

    Pieces that are alike in every column are interchangeable. An empty table gives an empty table.
    """
    spark = found.sparkSession
    prepare(spark)
    counts = {r.length: r.n for r in found.groupBy("length").agg(F.count("*").alias("n")).collect()}
    made = plan(counts, capacity, groups, large)
    salts = F.lit(1)
    hot = {k: -(-n // PART_ROWS) for k, n in counts.items() if n > PART_ROWS}
    if hot:
        table = F.create_map(*(F.lit(x) for kv in sorted(hot.items()) for x in kv))
        salts = F.coalesce(table[F.col("length")], F.lit(1))
    salted = found.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), salts.cast("long")))
    own = W.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32")
    numbered = salted.withColumn("n", F.row_number().over(own).cast("long") - 1)
    before = W.partitionBy("length").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)
    offsets = salted.groupBy("length", "salt").agg(F.count("*").alias("c")).withColumn("base", F.coalesce(F.sum("c").over(before), F.lit(0))).drop("c")
    whole = numbered.join(offsets, ["length", "salt"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("n") + F.col("base")).alias("n"))
    shared = spark.sparkContext.broadcast(made)  # its size is bounded by the capacity and the number of groups

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = shared.value.places(batch.column(3).to_numpy(), batch.column(5).to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    return whole.mapInArrow(lean(run), PIECES + ", sequence_id long, offset long")


def pack(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """Every document's pieces with their places in sequences of at most ``capacity`` tokens.

    Null texts are empty and consist of the end id alone. Repeated rows are packed as often as they occur. Tokens are
    counted once: the pieces are stored in the shared folder, as lengths and checksums.
    """
    return place(stored(pieces(docs, path, key, text, end_id, capacity), "pieces"), capacity)
