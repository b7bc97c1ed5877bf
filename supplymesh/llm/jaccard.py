"""Exact Jaccard join of documents on word shingles, by set size and list length, and its components.

Documents with equal shingle sets are one node, known by a 64-bit hash of the set, whatever their ids. Two nodes of a and b shingles link when they share at
least 4 (a + b) / 9 of them, which is a Jaccard similarity of 0.8. Nodes are joined by their size:

* small sets are enumerated: for each size that a partner may have, all subsets of exactly as many
  shingles as the two must share. Two small sets link if and only if they have such a subset in common.
* large sets, and small ones near the boundary, go into inverted lists by their prefix: the rarest
  fifth of their shingles and one more, of which two linked sets always share one.

The boundary is where enumerating all smaller sets would cost more than scanning lists for them.
Lists are scanned by their length: the sets of a short (light) list are paired, a pair stays if the
lists that it shares leave enough room for the overlap it needs, and is then verified on whole sets.
Sets that meet in a long (heavy) list are a family, and so are those that meet through others; where comparing
its lists one by one costs less, each list is a family of its own. A family is cut into blocks by size and hash, and
each pair of blocks of fitting sizes is compared in a task of its own, which returns a forest of links
rather than pairs. So no group of copies meets in one task or is expanded into its pairs.

Keys that hold over a thousandth of the rows (tokens, subsets, hubs of the graph, families), of which there can't be more than a
thousand, never go to a task of their own: their lists are heavy ones, found by counts and left where they are, and what
is looked up for them is broadcast.

Rarity is an order and no filter: it comes from a sketch of counts over all documents, of a fixed
size, so that results don't depend on its errors.
"""

from __future__ import annotations

import math
import secrets
import zlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from supplymesh.llm.bytehash import mix
from supplymesh.llm.common import checkpointed, lean, prepare, stored
from supplymesh.llm.shingles import shingle_sets

#: Cells of the counting sketch (a power of two), and the parts it is passed on in.
CELLS, CHUNKS = 1 << 20, 64
#: Sets in a light list at most; sets in a block of a family, and shingles in it, about.
LIGHT, BLOCK_SETS, BLOCK_SHINGLES = 32, 256, 400_000
#: No larger sets are enumerated; what scanning a list for one prefix shingle costs, in enumerated subsets.
SMALL_MOST, LIST_COST = 14, 8
#: Bits of the filter that tells which documents' sets are needed again. It only lets too many pass, never too few.
FILTER_BITS = 1 << 26
#: A key is hot with more than this part of all rows that have one.
HOT = 1000
#: Looked-up rows, of a few numbers each, that are broadcast without regard to how many rows ask for them.
FEW = 10_000
#: Rows that a task remembers, in order not to send the same one again.
MEMORY = 100_000
#: Stands for a null id where rows of a class are found by their ids.
_LAST = (1 << 63) - 1


def overlap_needed(a: int, b: int) -> int:
    """Shingles that sets of these sizes must share to link."""
    return -(-4 * (a + b) // 9)


def prefix_length(size: int) -> int:
    return size - -(-4 * size // 5) + 1


def partner_sizes(size: int) -> range:
    """Sizes of the sets that one of this size may link with."""
    return range(-(-4 * size // 5), 5 * size // 4 + 1)


def subsets_of(size: int) -> int:
    """How many subsets a set of this size is enumerated into."""
    return sum(math.comb(size, overlap_needed(size, b)) for b in partner_sizes(size))


def boundary(sizes: dict[int, int]) -> int:
    """The greatest size that is enumerated, given how many sets there are of each."""
    best = subsets = lists = 0
    for s in range(1, SMALL_MOST + 1):
        n = sizes.get(s, 0)
        subsets += n * subsets_of(s)
        lists += n * prefix_length(s) * LIST_COST
        if subsets <= lists:
            best = s
    return best


# --- passes over the texts -----------------------------------------------------------------------


def _key(own: np.ndarray) -> int:
    """A set's number, 64 bits, signed."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(own.tobytes())).astype("i8"))


def _cells(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(64 - CELLS.bit_length() + 1)).astype("i8")


def _fresh(keys: list[tuple], seen: set[tuple]) -> np.ndarray:
    """Which keys aren't among those remembered; equal rows of a hot key are so dropped before they are shuffled."""
    out = np.zeros(len(keys), "?")
    for i, k in enumerate(keys):
        if k not in seen:
            if len(seen) >= MEMORY:
                seen.clear()
            seen.add(k)
            out[i] = True
    return out


def measured(docs: DataFrame, seed: int) -> DataFrame:
    """First pass, of docs (doc_id, text, digest): (doc_id, digest, node, size) of each row; and, with null node, parts (chunk, counts) of the sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "digest", "node", "size", "chunk", "counts"]
        counts = np.zeros(CELLS, "u4")
        for batch in batches:
            sets = shingle_sets(batch.column(1).to_pylist(), seed)
            if any(len(s) for s in sets):
                counts += np.bincount(_cells(np.concatenate(sets)), minlength=CELLS).astype("u4")
            n = len(sets)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([_key(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names=names)
        if counts.any():
            parts = [zlib.compress(x.tobytes(), 1) for x in counts.reshape(CHUNKS, -1)]
            yield pa.RecordBatch.from_arrays([pa.nulls(CHUNKS, pa.int64())] * 4 + [pa.array(range(CHUNKS), pa.int32()), pa.array(parts, pa.binary())], names=names)

    return docs.mapInArrow(lean(run), "doc_id long, digest long, node long, size long, chunk int, counts binary")


def sketch(parts: DataFrame) -> np.ndarray:
    """The counts of all tasks together, streamed by chunk; the driver gets CELLS numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = sums.setdefault(chunk, np.zeros(CELLS // CHUNKS, "u8"))
                own += np.frombuffer(zlib.decompress(raw), "<u4")
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([zlib.compress(np.minimum(x, 0xFFFFFFFF).astype("<u4").tobytes(), 1) for x in sums.values()], pa.binary())], names=["chunk", "counts"])

    out = np.zeros((CHUNKS, CELLS // CHUNKS), "u4")
    for r in parts.repartition(CHUNKS, "chunk").mapInArrow(lean(run), "chunk int, counts binary").toLocalIterator():
        out[r.chunk] = np.frombuffer(zlib.decompress(r.counts), "<u4")
    return out.reshape(-1)


def prefixes(docs: DataFrame, counts: np.ndarray, small: int, seed: int) -> DataFrame:
    """Second pass, of docs (doc_id, text, digest): (doc_id, digest, node, size, prefix, whole) of rows with shingles; whole sets only of small ones. Of equal rows, a few."""
    shared = docs.sparkSession.sparkContext.broadcast(zlib.compress(counts.tobytes(), 1))  # CELLS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rarity, seen = np.frombuffer(zlib.decompress(shared.value), "<u4"), set()
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
        for batch in batches:
            ids, texts, digests = (c.to_pylist() for c in batch.columns)
            new = np.flatnonzero(_fresh(list(zip(ids, digests)), seen)).tolist()
            rows = []
            for i, own in zip(new, shingle_sets([texts[i] for i in new], seed)):
                if n := len(own):
                    first = np.lexsort((own, rarity[_cells(own)]))[: prefix_length(n)]
                    rows.append((ids[i], digests[i], _key(own), n, own[first].astype("i8"), own.astype("i8") if n <= small else None))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 6, kinds)], names=["doc_id", "digest", "node", "size", "prefix", "whole"])

    return docs.mapInArrow(lean(run), "doc_id long, digest long, node long, size long, prefix array<long>, whole array<long>")


def needed_sets(docs: DataFrame, wanted: DataFrame, seed: int) -> DataFrame:
    """Third pass, of docs (doc_id, text, digest): (node, own: set as binary) of the rows that are in wanted (doc_id, digest, node)."""
    spark = docs.sparkSession
    bit = F.pmod(F.xxhash64("doc_id", "digest"), F.lit(FILTER_BITS))
    words = wanted.select(bit.alias("b")).groupBy(F.floor(F.col("b") / 64).alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("b", F.lit(64)).cast("int"))).alias("m")).toArrow()
    table = np.zeros(FILTER_BITS // 64, "i8")  # a row of it for each word that has a bit: their number is bounded
    table[words.column(0).to_numpy()] = words.column(1).to_numpy()
    shared = spark.sparkContext.broadcast(zlib.compress(table.tobytes(), 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, seen = np.frombuffer(zlib.decompress(shared.value), "u1"), set()
        for batch in batches:
            b = batch.column(3).to_numpy()
            kept = batch.filter(pa.array((bits[b >> 3] >> (b & 7).astype("u1") & 1).astype("?")))
            kept = kept.filter(pa.array(_fresh(list(zip(kept.column(0).to_pylist(), kept.column(2).to_pylist())), seen)))
            sets = shingle_sets(kept.column(1).to_pylist(), seed)
            yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(2), pa.array([_key(x) for x in sets], pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())], names=["doc_id", "digest", "node", "own"])

    found = docs.select("doc_id", "text", "digest", bit.alias("bit")).mapInArrow(lean(run), "doc_id long, digest long, node long, own binary")
    return found.join(wanted, ["doc_id", "digest", "node"], "left_semi").select("node", "own").dropDuplicates(["node"])


# --- joins ---------------------------------------------------------------------------------------


def looked_up(rows: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """rows with what is found (keys, n: how many rows have them, other columns) for their keys. ``found`` is read several times, so it is a table or checkpoint.

    Up to FEW rows of it, counted here, are broadcast as they are. Of more, those over a part in HOT of all rows (the sum of n) are broadcast apart from
    the rest, so that no key's rows meet in one task; where there are none, that is a plain join."""
    number, most, total = found.agg(F.count("*"), F.max("n"), F.sum("n")).first()
    if number <= FEW:
        return rows.join(F.broadcast(found.drop("n")), keys)
    if most <= total / HOT:
        return rows.join(found.drop("n"), keys)
    hot = F.broadcast(found.filter(F.col("n") > total / HOT).drop("n"))  # at most HOT rows
    cold = found.filter(F.col("n") <= total / HOT).drop("n")
    return rows.join(hot, keys).unionByName(rows.join(hot, keys, "left_anti").join(cold, keys))


def small_links(nodes: DataFrame, small: int) -> DataFrame:
    """Links (u, v) between sets (node, size, whole) of at most ``small`` shingles, by common subsets of the needed size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, own, lesser = [], [], []
            for node, size, whole in zip(*(c.to_pylist() for c in batch.columns)):
                for other in partner_sizes(size):
                    if other > small:
                        continue
                    a, b = min(size, other), max(size, other)
                    picked = np.array(list(combinations(whole, overlap_needed(a, b))), "i8").view("u8")
                    h = mix(mix(picked).sum(axis=1) + np.uint64(1009 * a + b))
                    keys += h.astype("i8").tolist()
                    own += [node] * len(h)
                    lesser += [size == a] * len(h)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(own, pa.int64()), pa.array(lesser, pa.bool_())], names=["key", "node", "lesser"])

    rows = stored(nodes.filter(F.col("whole").isNotNull()).select("node", "size", "whole").mapInArrow(lean(run), "key long, node long, lesser boolean"), "subsets")
    # sets that share a subset link with the lesser ones among them, and so with the first of these
    first = rows.groupBy("key").agg(F.min(F.when(F.col("lesser"), F.col("node"))).alias("v"), F.min("node").alias("a"), F.max("node").alias("b"), F.count("*").alias("n")).filter("v is not null and a < b").select("key", "v", "n")
    return looked_up(rows, checkpointed(first), ["key"]).filter("node != v").select(F.col("node").alias("u"), "v").distinct()


def scanned(nodes: DataFrame, counts: np.ndarray) -> DataFrame:
    """The lists of the prefixes of nodes (node, size, prefix), scanned: pairs (u, su, v, sv) of light lists, one for each list that both are in; and, with
    null v, the (token, u, su) of heavy ones. Lists of one set give nothing. Lists are streamed in order; what is held is a light list at most.

    Tokens of hot lists are found by counting the tokens of crowded cells of the sketch, which no token exceeds; their rows
    are heavy as they are and aren't shuffled."""
    spark = nodes.sparkSession
    total = nodes.agg(F.sum(F.size("prefix"))).first()[0] or 0
    least = max(LIGHT, total // HOT)
    exploded = nodes.select(F.explode("prefix").alias("token"), "node", "size")
    crowded = F.broadcast(spark.createDataFrame(pa.table({"cell": pa.array(np.flatnonzero(counts > least), pa.int32())}), "cell int"))  # CELLS numbers at most
    cell = F.call_function("shiftrightunsigned", F.col("token"), F.lit(64 - CELLS.bit_length() + 1)).cast("int")
    suspects = exploded.select("token", cell.alias("cell")).join(crowded, "cell", "left_semi")
    hot = F.broadcast(checkpointed(suspects.groupBy("token").agg(F.count("*").alias("n")).filter(F.col("n") > least).select("token")))  # at most HOT tokens
    none = F.lit(None).cast("long")
    at_once = exploded.join(hot, "token", "left_semi").select("token", F.col("node").alias("u"), F.col("size").alias("su"), none.alias("v"), none.alias("sv"))
    postings = exploded.join(hot, "token", "left_anti").repartition("token").sortWithinPartitions("token", "size", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int]] = []
        token, heavy = None, False
        pairs: list[tuple[int, int, int, int]] = []
        rows: list[tuple[int, int, int]] = []

        def end() -> None:
            if not heavy:
                for i, (v, sv) in enumerate(held):
                    for u, su in held[:i]:
                        if 5 * su >= 4 * sv and u != v:
                            pairs.append((u, su, v, sv) if u < v else (v, sv, u, su))

        def out() -> pa.RecordBatch:
            n, m = len(pairs), len(rows)
            columns = list(zip(*pairs)) if pairs else [()] * 4
            t, u, s = zip(*rows) if rows else ((), (), ())
            made = pa.RecordBatch.from_arrays([pa.array([None] * n + list(t), pa.int64()), pa.array(list(columns[0]) + list(u), pa.int64()), pa.array(list(columns[1]) + list(s), pa.int64()), pa.array(list(columns[2]) + [None] * m, pa.int64()), pa.array(list(columns[3]) + [None] * m, pa.int64())], names=["token", "u", "su", "v", "sv"])
            pairs.clear()
            rows.clear()
            return made

        for batch in batches:
            t, d, s = (c.to_numpy() for c in batch.columns)
            if not len(t):
                continue
            same = np.zeros(len(t) + 1, "?")  # row i has the token of the row before it
            same[1:-1] = t[1:] == t[:-1]
            same[0] = token is not None and int(t[0]) == token
            wanted = np.flatnonzero(same[:-1] | same[1:])
            if not same[0]:
                end()
                held, heavy = [], False
            now = token if same[0] else None
            for i in wanted.tolist():
                x, row = int(t[i]), (int(d[i]), int(s[i]))
                if x != now:
                    end()
                    held, heavy, now = [], False, x
                if heavy:
                    rows.append((x, *row))
                    continue
                if row not in held:
                    held.append(row)
                    if len(held) > LIGHT:
                        heavy = True
                        rows.extend((x, *r) for r in held)
                        held = []
            last = int(t[-1])
            if last != now:  # the last row's list begins with it
                end()
                held, heavy = [(int(d[-1]), int(s[-1]))], False
            token = last
            if len(pairs) + len(rows) > 20_000:
                yield out()
        end()
        yield out()

    return postings.mapInArrow(lean(run), "token long, u long, su long, v long, sv long").unionByName(at_once)


def light_candidates(found: DataFrame) -> DataFrame:
    """Pairs (u, v) of light lists that can still link: of two prefixes, the one that ends first lies wholly before the end of the
    other, so what it shares beyond the common lists is at most the rest of its set; in heavy lists two sets share at most what either has there."""
    light = found.filter("v is not null").groupBy("u", "su", "v", "sv").agg(F.count("*").alias("k"))
    heavy = found.filter("v is null").groupBy("u").agg(F.count("*").alias("h"))
    both = light.join(heavy.select("u", F.col("h").alias("hu")), "u", "left").join(heavy.select(F.col("u").alias("v"), F.col("h").alias("hv")), "v", "left")
    rest = F.greatest(F.floor((4 * F.col("su") + 4) / 5), F.floor((4 * F.col("sv") + 4) / 5)) - 1
    shared = F.col("k") + F.coalesce(F.least("hu", "hv"), F.lit(0)) * (F.col("hu").isNotNull() & F.col("hv").isNotNull()).cast("long")
    return both.filter(shared + rest >= F.floor((4 * (F.col("su") + F.col("sv")) + 8) / 9)).select("u", "v")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (u, v) whose sets (node, own) share enough."""
    whole = pairs.join(sets.select(F.col("node").alias("u"), F.col("own").alias("x")), "u").join(sets.select(F.col("node").alias("v"), F.col("own").alias("y")), "v").select("u", "v", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                a, b = np.frombuffer(x, "u8"), np.frombuffer(y, "u8")
                good.append(len(np.intersect1d(a, b, assume_unique=True)) >= overlap_needed(len(a), len(b)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["u", "v"]).filter(pa.array(good, pa.bool_()))

    return whole.mapInArrow(lean(run), "u long, v long").distinct()


def families(found: DataFrame) -> DataFrame:
    """The sets (node, size, family) that may link through heavy lists: those that meet in them, directly or through others; or, where the squares
    of its lists add up to less than its own, each list of such a family alone."""
    heavy = found.filter("v is null").select("token", "u", "su")
    lists = checkpointed(heavy.groupBy("token").agg(F.min("u").alias("v"), F.count("*").alias("n")))
    roots = checkpointed(components(looked_up(heavy, lists, ["token"]).filter("u != v").select("u", "v").distinct()))
    of_list = lists.join(roots.select(F.col("u").alias("v"), F.col("component").alias("family")), "v").select("token", "n", "family")
    one_by_one = of_list.groupBy("family").agg(F.sum(F.col("n").cast("double") * F.col("n")).alias("squares"))
    whole = roots.groupBy(F.col("component").alias("family")).agg(F.count("*").alias("n"))
    cut = checkpointed(whole.join(one_by_one, "family").filter(F.col("squares") < F.col("n").cast("double") * F.col("n")).select("family"))
    lone = checkpointed(of_list.join(cut, "family", "left_semi").select("token", "n"))
    alone = looked_up(heavy, lone, ["token"]).select(F.col("u").alias("node"), F.col("su").alias("size"), F.xxhash64(F.lit(1), "token").alias("family"))
    sized = heavy.select(F.col("u").alias("node"), F.col("su").alias("size")).distinct()
    rest = roots.withColumnRenamed("u", "node")
    counted = whole.join(cut, "family", "left_anti").withColumnRenamed("family", "component")
    together = sized.join(looked_up(rest, checkpointed(counted), ["component"]), "node").select("node", "size", F.xxhash64(F.lit(2), "component").alias("family"))
    return together.unionByName(alone)


def family_links(members: DataFrame, sets: DataFrame) -> DataFrame:
    """A forest of the links (u, v) within each family (node, size, family) of sets (node, own).

    Sets that may link are at most one class of sizes apart, classes growing by a quarter. Each class is dealt into blocks by hash."""
    sized = members.withColumn("c", F.floor(F.log(F.col("size").cast("double")) / math.log(1.25) + 1e-9).cast("int"))
    blocks = checkpointed(sized.groupBy("family", "c").agg(F.ceil(F.greatest(F.count("*") / BLOCK_SETS, F.sum("size") / BLOCK_SHINGLES)).cast("int").alias("blocks"), F.count("*").alias("n")))
    at = lambda shift, name: blocks.select("family", (F.col("c") + shift).alias("c"), F.col("blocks").alias(name))
    around = checkpointed(blocks.join(at(-1, "above"), ["family", "c"], "left").join(at(1, "below"), ["family", "c"], "left"))
    placed = looked_up(sized, around, ["family", "c"]).withColumnRenamed("blocks", "n")
    h = F.pmod(F.xxhash64("node"), F.col("n")).cast("int")
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    key = lambda c1, h1, c2, h2: F.struct(c1.alias("c1"), h1.alias("h1"), c2.alias("c2"), h2.alias("h2"))
    c = F.col("c")
    tasks = F.concat(
        F.transform(upto(F.col("n")), lambda x: key(c, F.least(x, h), c, F.greatest(x, h))),
        F.transform(upto(F.coalesce("above", F.lit(0))), lambda x: key(c, h, c + 1, x)),
        F.transform(upto(F.coalesce("below", F.lit(0))), lambda x: key(c - 1, x, c, h)),
    )
    dealt = placed.select("node", "family", F.explode(tasks).alias("t")).select("node", "family", "t.*").join(sets.select("node", "own"), "node")

    def compare(table: pa.Table) -> pa.Table:
        ids = table.column("node").to_numpy()
        owns = [np.frombuffer(x, "u8") for x in table.column("own").to_pylist()]
        n, size = len(ids), np.array([len(x) for x in owns], "i8")
        every, inverse, times = np.unique(np.concatenate(owns), return_inverse=True, return_counts=True)
        number = np.full(len(every), -1, "i8")
        several = np.flatnonzero(times > 1)
        number[several] = np.arange(len(several))
        column, row = number[inverse], np.repeat(np.arange(n), size)
        keep = column >= 0
        column, row = column[keep], row[keep]
        order = np.argsort(column, kind="stable")
        column, row = column[order], row[order]
        share = np.zeros((n, n), "f4")
        step = max(256, (8 << 20) // (4 * n))
        for begin in range(0, len(several), step):
            low, high = np.searchsorted(column, (begin, begin + step))
            part = np.zeros((n, step), "f4")
            part[row[low:high], column[low:high] - begin] = 1
            share += part @ part.T
        link = 9 * np.rint(share).astype("i8") >= 4 * (size[:, None] + size[None, :])
        np.fill_diagonal(link, True)
        label = np.argsort(np.argsort(ids, kind="stable"), kind="stable")
        while True:
            new = np.where(link, label[None, :], n).min(axis=1)
            if (new == label).all():
                break
            label = new
        root = np.sort(ids, kind="stable")[label]
        off = root != ids
        return pa.table({"u": pa.array(ids[off], pa.int64()), "v": pa.array(root[off], pa.int64())})

    return dealt.groupBy("family", "c1", "h1", "c2", "h2").applyInArrow(compare, "u long, v long").distinct()


# --- components ----------------------------------------------------------------------------------


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(u, component) of every node in links (u, v): the least node that it reaches. By alternating large and small stars.

    The neighbours of a hub never meet: least neighbours are aggregated before the shuffle, and a hub's is broadcast to its links."""
    links = checkpointed(links.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    for _ in range(rounds):
        ends = F.count_distinct("u").alias("ends")
        total, ends = links.agg(F.count("*"), ends).first()
        if ends == total and links.join(links.select(F.col("v").alias("u")).distinct(), "u", "left_semi").isEmpty():
            break  # stars: each node has one link, to a node without one
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = checkpointed(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n")))
        links = checkpointed(looked_up(both, least, ["u"]).filter("v > u and v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = checkpointed(links.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")))
        joined = looked_up(links, least, ["u"])
        links = checkpointed(joined.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct())
    else:
        raise RuntimeError("components haven't settled")
    ends = links.select("u", F.col("v").alias("component"))
    return ends.unionByName(ends.select(F.col("component").alias("u"), "component").distinct())


def linked(docs: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(doc_id, digest of the text, node, size) of each row, and (node, size, n: rows, rep: least doc_id, component: its least node) of each class of equal sets with shingles."""
    spark: SparkSession = docs.sparkSession
    prepare(spark)
    seed = secrets.randbits(64)  # of all shingle hashes of this run
    base = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text")).withColumn("digest", digest("text"))
    first = stored(measured(base, seed), "shingles")
    rows = first.filter("node is not null").select("doc_id", "digest", "node", "size")
    known = F.struct(F.coalesce("doc_id", F.lit(_LAST)).alias("doc_id"), "digest")
    classes = checkpointed(rows.filter("size > 0").groupBy("node", "size").agg(F.min("doc_id").alias("rep"), F.min(known).alias("at"), F.count("*").alias("n")))
    small = boundary({r.size: r.n for r in classes.filter(F.col("size") <= SMALL_MOST).groupBy("size").agg(F.count("*").alias("n")).collect()})
    counts = sketch(first.filter("node is null").select("chunk", "counts"))
    base = base.withColumn("doc_id", F.coalesce("doc_id", F.lit(_LAST)))
    reps = classes.select("at.doc_id", "at.digest", "node")
    nodes = stored(prefixes(base, counts, small, seed).join(reps, ["doc_id", "digest", "node"], "left_semi").drop("doc_id", "digest").dropDuplicates(["node"]), "prefixes")
    in_lists = nodes.filter(F.col("size") >= (4 * (small + 1) + 4) // 5)
    found = stored(scanned(in_lists, counts), "lists")
    pairs = checkpointed(light_candidates(found))
    members = checkpointed(families(found))
    wanted = pairs.select(F.col("u").alias("node")).unionByName(pairs.select(F.col("v").alias("node"))).unionByName(members.select("node")).distinct()
    sets = stored(needed_sets(base, checkpointed(reps.join(wanted, "node", "left_semi")), seed), "sets")
    links = small_links(nodes, small).unionByName(verified(pairs, sets)).unionByName(family_links(members, sets))
    found_in = components(links).withColumnRenamed("u", "node")
    return rows, checkpointed(classes.join(found_in, "node", "left").select("node", "size", "n", "rep", F.coalesce("component", "node").alias("component")))


def digest(text: str) -> Column:
    """A number of a text, 64 bits, by which texts are told apart."""
    return F.xxhash64(F.col(f"`{text}`").cast("string"))


def joined(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each row's doc_id, n_shingles and component_id: the least doc_id of what it reaches by links, itself included.

    Null and blank texts have no shingles and no links. Rows are linked by their texts alone, also where their key is null or
    repeated: texts that share a key are judged apart, so that rows of one key may be in several components; a component is null if only rows with a null key are in it. An empty table gives none; other columns aren't used.
    """
    rows, classes = linked(docs, key, text)
    least = checkpointed(classes.groupBy("component").agg(F.min("rep").alias("component_id"), F.count("*").alias("n")))
    of_class = checkpointed(looked_up(classes, least, ["component"]).select("node", "size", "n", "component_id"))
    out = looked_up(rows.filter("size > 0").drop("digest"), of_class, ["node", "size"]).select("doc_id", F.col("size").alias("n_shingles"), "component_id")
    return out.unionByName(rows.filter("size = 0").select("doc_id", F.col("size").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def kept(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, digest) of the rows to keep of near copies: of each component the one with the least doc_id, or where all its keys are null the one of the least digest.
    Rows without shingles are all among them."""
    rows, classes = linked(docs, key, text)
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "digest"))).alias("named")
    unnamed = F.min(F.when(F.col("doc_id").isNull(), F.col("digest"))).alias("unnamed")
    of_class = rows.filter("size > 0").groupBy("node", "size").agg(first, unnamed).join(classes.select("node", "size", "component"), ["node", "size"])
    best = checkpointed(of_class.groupBy("component").agg(F.min("named").alias("named"), F.min("unnamed").alias("unnamed")))
    nameless = F.struct(F.lit(None).cast("long").alias("doc_id"), F.col("unnamed").alias("digest"))
    out = best.select(F.coalesce("named", nameless).alias("first")).select("first.*")
    return out.unionByName(rows.filter("size = 0").select("doc_id", "digest")).distinct()
