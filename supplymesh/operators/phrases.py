"""Phrases of a dictionary in texts, and which of them stand near each other, without a pattern for each phrase.

A text is its words with their places. A phrase is looked up by the one of its words that is rarest in the texts; where that word stands, the phrase's other words are
looked up at the places that they must have. Texts are never shuffled, and with a dictionary too large for each task only the places of its words are.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from supplymesh.sources.scratch import kept

#: Words of a dictionary up to which it is broadcast; a larger one is joined by shuffles.
BROADCAST_WORDS = 200_000
#: Words of more than this part of all places are dealt into parts of a join; there can't be more of them than this.
HOT = 1000
#: A word: a run of letters and digits.
WORD = re.compile(r"[^\W_]+")


def word_positions(texts: DataFrame, id_column: str, text: str, only: frozenset[str] | None = None) -> DataFrame:
    """(id, at, start, end, word) of each text's words: runs of letters and digits, lower case, counted from 0; start and end count characters. With ``only``, a set
    of a size that its maker has checked, other words are left out. Null texts have none."""
    spark = texts.sparkSession
    kind = dict(texts.dtypes)[id_column]
    shared = spark.sparkContext.broadcast(only) if only is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = shared.value if shared else None
        for b in batches:
            ids, at, start, end, words = [], [], [], [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                for n, m in enumerate(WORD.finditer(t or "")):
                    w = m[0].lower()
                    if wanted is None or w in wanted:
                        ids.append(i)
                        at.append(n)
                        start.append(m.start())
                        end.append(m.end())
                        words.append(w)
                if len(ids) > 200_000 or i + 1 == b.num_rows:  # a batch out is bounded too
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(ids, pa.int32())), pa.array(at, pa.int32()), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(words, pa.string())], names=["id", "at", "start", "end", "word"])
                    ids, at, start, end, words = [], [], [], [], []

    return texts.select(F.col(id_column).alias("id"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"id {kind}, at int, start int, end int, word string")


def mentions(texts: DataFrame, phrases: DataFrame, id_column: str, text: str) -> DataFrame:
    """(id, phrase_id, at, start, end) of every place where the words of a phrase stand in a row, whatever else than letters and digits is between them.
    ``texts`` has unique ids that aren't null; ``phrases`` is (phrase_id, phrase) with unique phrase_ids. Phrases without words are nowhere.

    A dictionary of up to BROADCAST_WORDS words in all goes to every task: one pass counts its words, a second one finds the phrases, and nothing but them leaves a task. A larger one is joined with
    the places of its words, and places of a hot word are dealt into parts."""
    asked = kept(word_positions(phrases, "phrase_id", "phrase").select(F.col("id").alias("phrase_id"), F.col("at").alias("offset"), "word"), "phrase-words")
    return _looked_up(texts, asked, id_column, text) if asked.count() <= BROADCAST_WORDS else _joined_mentions(texts, asked, id_column, text)


def _looked_up(texts: DataFrame, asked: DataFrame, id_column: str, text: str) -> DataFrame:
    spark = texts.sparkSession
    spelt: dict = {}
    for r in asked.orderBy("phrase_id", "offset").collect():
        spelt.setdefault(r["phrase_id"], []).append(r["word"])
    vocabulary = frozenset(w for words in spelt.values() for w in words)
    plain = texts.select(F.col(id_column).alias("id"), F.col(text).cast("string").alias("text"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[str] = Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                found.update(w for w in map(str.lower, WORD.findall(t or "")) if w in vocabulary)
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["word", "n"])

    often = {r["word"]: r["n"] for r in plain.select("text").mapInArrow(counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()}  # one for each word of the dictionary
    anchors: dict[str, list[tuple]] = {}
    for phrase_id, words in spelt.items():
        if all(w in often for w in words):  # a phrase that has a word which no text has is nowhere
            offset = min(range(len(words)), key=lambda j: (often[words[j]], j))
            anchors.setdefault(words[offset], []).append((phrase_id, offset, words))
    shared = spark.sparkContext.broadcast(anchors)
    kinds = dict(texts.dtypes)[id_column], dict(asked.dtypes)["phrase_id"]
    of_phrase = to_arrow_type(asked.schema["phrase_id"].dataType)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for b in batches:
            rows: list[tuple] = []
            for i, t in enumerate(b.column(1).to_pylist()):
                own = [w.lower() for w in WORD.findall(t or "")]
                hits = [(n, x) for n, w in enumerate(own) if w in known for x in known[w]]
                fits = [(p, n - offset, len(words)) for n, (p, offset, words) in hits if n >= offset and own[n - offset : n - offset + len(words)] == words]
                if fits:
                    spans = [m.span() for m in WORD.finditer(t)]
                    rows += [(i, p, first, spans[first][0], spans[first + n - 1][1]) for p, first, n in fits]
                while len(rows) >= 100_000 or rows and i + 1 == b.num_rows:  # a batch out is bounded too
                    now, rows = rows[:100_000], rows[100_000:]
                    ids, p, at, start, end = zip(*now)
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(ids, pa.int32())), pa.array(p, of_phrase), *(pa.array(x, pa.int32()) for x in (at, start, end))], names=["id", "phrase_id", "at", "start", "end"])

    return plain.mapInArrow(found, f"id {kinds[0]}, phrase_id {kinds[1]}, at int, start int, end int")


def _joined_mentions(texts: DataFrame, asked: DataFrame, id_column: str, text: str) -> DataFrame:
    places = kept(word_positions(texts, id_column, text).join(asked.select("word").distinct(), "word", "left_semi").select("id", "at", "start", "end", "word"), "word-places")
    often = places.groupBy("word").agg(F.count("*").alias("often"))
    rarest = asked.join(often, "word", "left").groupBy("phrase_id").agg(F.count("*").alias("words"), F.count("often").alias("known"), F.min(F.struct("often", "offset", "word")).alias("x")).filter("words = known")
    anchors = kept(rarest.select("phrase_id", "words", "x.offset", "x.word", "x.often"), "phrase-anchors")
    begun = _joined(places.select("id", "at", "word"), anchors).select("id", "phrase_id", "words", (F.col("at") - F.col("offset")).alias("first")).filter("first >= 0")
    expected = begun.join(asked, "phrase_id").select("id", "phrase_id", "words", "first", (F.col("first") + F.col("offset")).alias("at"), "word")
    there = expected.join(places, ["id", "at", "word"])
    return there.groupBy("id", "phrase_id", "first", "words").agg(F.count("*").alias("n"), F.min("start").alias("start"), F.max("end").alias("end")).filter("n = words").select("id", "phrase_id", F.col("first").alias("at"), "start", "end")


def _joined(places: DataFrame, anchors: DataFrame) -> DataFrame:
    """places and anchors by word; the places of a hot word are dealt into parts of a thousandth of all, each with its own copy of the anchors."""
    total = anchors.agg(F.sum("often")).first()[0] or 1
    parts = F.ceil(F.col("often") * HOT / total).cast("int")
    hot = F.broadcast(anchors.filter(F.col("often") * HOT > total).select("word", parts.alias("parts")).distinct())  # HOT words at most
    dealt = places.join(hot, "word", "left").withColumn("part", F.floor(F.rand(3) * F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
    return dealt.join(anchors.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))), ["word", "part"]).drop("part")


def within(left: DataFrame, right: DataFrame, most: int) -> DataFrame:
    """Pairs of rows (id, start, end, ...) of one text where right begins after left has ended, at most so many characters later: (id, left, right), both as structs.

    Joined by bands: left goes to the band in which it ends and the next one, right to that in which it begins, so that a text is many groups, none of which holds more than what
    stands in two bands."""
    a = left.select("id", F.struct(*(c for c in left.columns if c != "id")).alias("left")).withColumn("band", F.explode(F.array(F.floor(F.col("left.end") / (most + 1)), F.floor(F.col("left.end") / (most + 1)) + 1)))
    b = right.select("id", F.struct(*(c for c in right.columns if c != "id")).alias("right")).withColumn("band", F.floor(F.col("right.start") / (most + 1)))
    apart = F.col("right.start") - F.col("left.end")
    return a.join(b, ["id", "band"]).filter((apart >= 0) & (apart <= most)).select("id", "left", "right")


def directed(found: DataFrame, links: DataFrame, most: int = 120) -> DataFrame:
    """(id, candidate, source, link) where a mention is followed by a link word and that by another phrase's mention, each at most so many characters on: found is (id, phrase_id, start, end),
    links is (id, word, start, end)."""
    first = within(found.select("id", "phrase_id", "start", "end"), links.select("id", "word", "start", "end"), most)
    middle = first.select("id", F.col("left.phrase_id").alias("candidate"), F.col("right.word").alias("link"), F.col("right.start").alias("start"), F.col("right.end").alias("end"))
    both = within(middle, found.select("id", F.col("phrase_id").alias("source"), "start", "end"), most)
    return both.select("id", "left.candidate", "right.source", "left.link").filter("candidate <> source")
