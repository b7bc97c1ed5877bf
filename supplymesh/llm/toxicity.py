"""Toxic passages by maximum-scoring segment search.

Terms (words and word beginnings) get log-odds of toxic against other documents, with an
informative Dirichlet prior: the share that a term has of all sampled documents. Only what stays
positive after one and a half standard errors counts; every other word costs a little. One scan over a text's
words then finds all maximal-scoring segments, in linear time. Scores of the best segment in
non-toxic text follow an extreme-value law, whose rate is the root of E[exp(rate * score)] = 1 and
whose size is fitted to sampled documents; a segment is significant if fewer than one as good is
expected in a text of its length. A document's evidence is the sum over its significant segments of
-log(expected number), and logistic regression on it gives the score.

Terms are weighed without the fold of sampled documents they are judged on, so that the law and the
regression see scores as unseen documents get them.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from supplymesh.llm.common import crc_remainder, lean, prepare, sampled, schema_with, spare, stored

#: Labelled documents used of each kind at most, about; folds.
TOXIC_SAMPLE, OTHER_SAMPLE, FOLDS = 4000, 6000, 4
#: Lengths of word beginnings; weight of the prior, as a part of the sampled documents; standard errors taken off; cost of a word that tells nothing.
PREFIXES, PRIOR, ERRORS, COST = (4, 5, 6, 7), 0.03, 1.5, 0.3
#: The law's rate where the mean score of a word isn't negative, so that no rate solves its equation: long passages then need very high scores.
SLOWEST = 0.05
#: Words that a worker remembers.
MEMORY = 100_000
_WORD = re.compile(r"\w+")


def terms(word: str) -> list[str]:
    """The terms of a lower-cased word: itself, and its beginnings, marked by a hyphen."""
    return [word, *(word[:n] + "-" for n in PREFIXES if len(word) > n)]


def segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (begin, end, score) of a sequence, in order: no other one overlaps a segment and beats it.

    Each candidate joins the nearest earlier one that began lower, as long as it ends higher; candidates keep the
    index of that earlier one, so each is looked at a constant number of times.
    """
    begin, end, low, high, back = [], [], [], [], []
    total = 0.0
    for i, s in enumerate(scores):
        if s <= 0:
            total += s
            continue
        b, left = i, total
        total += s
        right = total
        j = len(begin) - 1
        while True:
            while j >= 0 and low[j] >= left:
                j = back[j]
            if j < 0 or high[j] >= right:
                break
            b, left = begin[j], low[j]
            following = back[j]
            del begin[j:], end[j:], low[j:], high[j:], back[j:]
            j = following
        begin.append(b)
        end.append(i + 1)
        low.append(left)
        high.append(right)
        back.append(j)
    return [(b, e, h - lo) for b, e, lo, h in zip(begin, end, low, high)]


@dataclass
class Model:
    #: Positive scores of terms.
    weights: dict[str, float]
    #: The extreme-value law: n words have size * n * exp(-rate * x) segments of score x or more to be expected.
    rate: float = 1.0
    size: float = 1.0
    #: The regression: log-odds = intercept + slope * log(1 + evidence).
    intercept: float = 0.0
    slope: float = 0.0
    memory: dict[str, float] = field(default_factory=dict, repr=False, compare=False)

    def __getstate__(self):
        return self.__dict__ | {"memory": {}}

    def word(self, word: str) -> float:
        """The best positive score of its terms, less the cost; else minus the cost."""
        found = self.memory.get(word)
        if found is None:
            if len(self.memory) >= MEMORY:
                self.memory.clear()
            get = self.weights.get
            found = max([get(t, 0.0) for t in terms(word)]) - COST
            self.memory[word] = found
        return found

    def passages(self, text: str) -> tuple[int, list[tuple[int, int, float]]]:
        """The number of words, and all maximal-scoring segments of words."""
        words = _WORD.findall(text.lower())
        of = {w: self.word(w) for w in set(words)}
        if not any(s > 0 for s in of.values()):
            return len(words), []
        scores, seen = [of[w] for w in words], Counter()
        for i, x in enumerate(scores):
            if x > 0:  # a word tells less each time that it is said again
                seen[words[i]] += 1
                scores[i] = x / seen[words[i]]
        return len(words), segments(scores)

    def expected(self, words: int, score: float) -> float:
        return self.size * words * math.exp(-self.rate * score)

    def judge(self, text: str | None) -> tuple[float, float, list[tuple[int, int, float, float]]]:
        """Score from 0 to 1, evidence, and the significant passages: words from and up to, segment score, expected number."""
        n, found = self.passages(text or "")
        kept = [(b, e, s, x) for b, e, s in found if (x := self.expected(n, s)) < 1]
        evidence = sum(-math.log(max(x, 1e-300)) for *_, x in kept)
        z = self.intercept + self.slope * math.log1p(evidence)
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, z)))), evidence, kept


def weigh(toxic: np.ndarray, other: np.ndarray, n_toxic: float, n_other: float) -> np.ndarray:
    """Log-odds of terms found in so many toxic and other documents, less their standard errors; 0 if not positive."""
    weight = PRIOR * (n_toxic + n_other)
    prior = weight * (toxic + other + 0.5) / (n_toxic + n_other + 1)
    a, b = toxic + prior, other + prior
    odds = np.log(a / np.maximum(n_toxic + weight - a, 0.5)) - np.log(b / np.maximum(n_other + weight - b, 0.5))
    return np.maximum(0.0, odds - ERRORS * np.sqrt(1 / a + 1 / b))


def weight_column(toxic: Column, other: Column, n_toxic: float, n_other: float) -> Column:
    """``weigh`` as a column."""
    weight = PRIOR * (n_toxic + n_other)
    prior = weight * (toxic + other + 0.5) / (n_toxic + n_other + 1)
    a, b = toxic + prior, other + prior
    odds = F.log(a / F.greatest(n_toxic + weight - a, F.lit(0.5))) - F.log(b / F.greatest(n_other + weight - b, F.lit(0.5)))
    return F.greatest(F.lit(0.0), odds - ERRORS * F.sqrt(1 / a + 1 / b))


def _rate(scores: Counter, total: float) -> float:
    """The positive root of E[exp(rate * score)] = 1 by bisection, for positive scores and otherwise the cost; SLOWEST if there is none."""
    if not scores:
        return 1.0
    rest = max(0.0, 1 - sum(scores.values()) / total)

    def excess(r: float) -> float:
        return rest * math.exp(-COST * r) + sum(n / total * math.exp(min(700.0, r * s)) for s, n in scores.items()) - 1

    low, high = 1e-6, 1.0
    if excess(low) >= 0:  # the mean score isn't negative
        return SLOWEST
    while excess(high) < 0 and high < 64:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if excess(mid) < 0 else (low, mid)
    return low


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, usual: float = 1.5, least: float = 0.5) -> tuple[float, float]:
    """Intercept and slope of a regression by Newton's method, the slope drawn slightly to the usual one: more evidence never tells for less, however few documents there are."""

    def solve(slope: float | None) -> np.ndarray:
        w = np.array([0.0, usual if slope is None else slope])
        free = np.array([1.0, float(slope is None)])
        a = np.stack([np.ones_like(x), x], axis=1)
        for _ in range(60):
            p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
            h = (a * (weight * p * (1 - p))[:, None]).T @ a + np.diag([1e-3, 0.5])
            g = (a.T @ (weight * (y - p)) - np.array([1e-3, 0.5]) * (w - np.array([0.0, usual]))) * free
            step = np.clip(np.linalg.solve(h, g), -2, 2) if slope is None else np.array([np.clip(g[0] / h[0, 0], -2, 2), 0.0])
            w = w + step
            if np.abs(step).max() < 1e-8:
                break
        return w

    w = solve(None)
    w = w if w[1] >= least else solve(least)
    return float(w[0]), float(w[1])


def fit(sample: DataFrame, kinds: tuple[float, float]) -> Model:
    """A model from a bounded table (text, toxic 0 or 1, fold), read three times; kinds: how many labelled documents there are of each, other and toxic.

    Terms are counted and weighed in Spark. The driver gets the counts by fold of all terms whose weight is over COST in the model or in
    that of a fold, and a row for each sampled document. A term that one toxic document has never passes: its standard errors outweigh its odds.
    """
    spark = sample.sparkSession
    prepare(spark)
    sizes = {(r.fold, r.toxic): r.n for r in sample.groupBy("fold", "toxic").agg(F.count("*").alias("n")).collect()}
    n = [sum(v for (_, t), v in sizes.items() if t == k) for k in (0, 1)]
    if not n[0] or not n[1]:
        return Model({}, intercept=20.0 if n[1] else -20.0)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums: dict[tuple[int, int], Counter] = {}
            for body, *group in zip(*(c.to_pylist() for c in batch.columns)):
                sums.setdefault(tuple(group), Counter()).update({t for w in set(_WORD.findall(body.lower())) for t in terms(w)})
            rows = [(t, f, k, c) for (f, k), own in sums.items() for t, c in own.items()]
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 4, kinds)], names=["term", "fold", "toxic", "c"])

    def rest(fold: int | None) -> list[int]:
        """Sampled other and toxic documents without those of a fold."""
        return [max(1, n[k] - (sizes.get((fold, k), 0) if fold is not None else 0)) for k in (0, 1)]

    cells = [(k, f) for k in (0, 1) for f in range(FOLDS)]
    counted = sample.select("text", "fold", "toxic").mapInArrow(lean(count), "term string, fold int, toxic int, c long").groupBy("term")
    counted = counted.agg(*(F.sum(F.when((F.col("fold") == f) & (F.col("toxic") == k), F.col("c")).otherwise(0)).alias(f"c{k}{f}") for k, f in cells))
    best = []
    for fold in (None, *range(FOLDS)):
        other, toxic = (sum((F.col(f"c{k}{f}") for f in range(FOLDS) if f != fold), F.lit(0.0)) for k in (0, 1))
        best.append(weight_column(toxic, other, *rest(fold)[::-1]))
    said = sum((F.col(f"c1{f}") for f in range(FOLDS)), F.lit(0)) > 0
    rows = sorted(counted.filter(said).filter(F.greatest(*best) > COST - 1e-6).collect())  # by sampled documents only, a bounded number of which are; sorted here, as a sort in Spark would weigh twice
    names = [r.term for r in rows]
    counts = np.array([r[1:] for r in rows], "f8").reshape(len(rows), 2, FOLDS).transpose(1, 2, 0)

    def model(fold: int | None) -> Model:
        own = counts.sum(axis=1) - (counts[:, fold] if fold is not None else 0)
        w = weigh(own[1], own[0], *rest(fold)[::-1])
        return Model({t: float(x) for t, x in zip(names, w) if x > COST})

    shared = spark.sparkContext.broadcast([model(f) for f in range(FOLDS)])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for body, fold, toxic in zip(*(c.to_pylist() for c in batch.columns)):
                own = shared.value[fold]
                words, found = own.passages(body)
                positive = Counter()
                if not toxic and found:
                    positive.update(round(s, 1) for s in map(own.word, _WORD.findall(body.lower())) if s > 0)
                rows.append((toxic, words, [float(s) for _, _, s in found], [float(k) for k in positive], [float(v) for v in positive.values()]))
            kinds = (pa.int32(), pa.int64(), *[pa.list_(pa.float64())] * 3)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 5, kinds)], names=["toxic", "words", "found", "score", "times"])

    judged = sample.select("text", "fold", "toxic").mapInArrow(lean(judge), "toxic int, words long, found array<double>, score array<double>, times array<double>").collect()
    made = model(None)
    others = [r for r in judged if not r.toxic and r.words]
    positive: Counter = Counter()
    for r in others:
        for s, c in zip(r.score, r.times):
            positive[max(0.1, s)] += c
    made.rate = _rate(positive, max(1, sum(r.words for r in others)))
    made.size = max(1, len(others)) / max(1e-9, sum(r.words * math.exp(-made.rate * max(r.found, default=0.0)) for r in others))
    x = np.array([math.log1p(sum(-math.log(max(e, 1e-300)) for s in r.found if (e := made.expected(r.words, s)) < 1)) for r in judged])
    y = np.array([r.toxic for r in judged], "f8")
    made.intercept, made.slope = _logistic(x, y, np.where(y > 0, kinds[1] / n[1], kinds[0] / n[0]))
    return made


#: Documents whose crc32(doc_id) has remainder 0 are held out.
MODULUS = 5


def held_out(key: str = "doc_id"):
    return crc_remainder(key, MODULUS) == 0


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """A model from labelled documents that aren't held out.

    About TOXIC_SAMPLE toxic and OTHER_SAMPLE other ones are used, by a hash of their key: documented bounds. Their
    texts are used whole, equal texts once. A document labelled twice is toxic if any label says so; null labels don't count.
    """
    known = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull() & ~held_out(key)).groupBy(F.col(key).alias("k")).agg(F.max((F.col(label) > 0).cast("int")).alias("toxic"))
    kinds = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n = (kinds.get(0, 0), kinds.get(1, 0))
    share = F.when(F.col("toxic") == 1, min(1.0, TOXIC_SAMPLE / max(1, n[1]))).otherwise(min(1.0, OTHER_SAMPLE / max(1, n[0])))
    chosen = known.filter(sampled("k", share, 7)).withColumn("fold", F.pmod(F.xxhash64("k", F.lit(9)), F.lit(FOLDS)).cast("int"))
    joined = docs.select(F.col(f"`{key}`").alias("k"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text")).join(F.broadcast(chosen), "k")  # bounded by the samples
    once = joined.groupBy(F.xxhash64("text").alias("h")).agg(F.min_by(F.struct("text", "toxic", "fold"), "k").alias("x")).select("x.*")
    return fit(stored(once, "toxicity"), n)


def detect(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with score, predicted, evidence and passages (first word, word after the last, segment score, expected number), from the text alone.

    Null and empty texts have no passages and the score that goes with that. Columns of these names give way; no shuffle.
    """
    prepare(docs.sparkSession)
    new = ["score", "predicted", "evidence", "passages"]
    source = spare(docs, "__text")
    kept = docs.withColumn(source, F.col(f"`{text}`").cast("string")).drop(*new)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the terms of sampled documents that pass their test
    inner = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("expected", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            at = batch.schema.get_field_index(source)
            judged = [own.judge(t) for t in batch.column(at).to_pylist()]
            passages = [[{"begin": b, "end": e, "score": s, "expected": x} for b, e, s, x in found] for *_, found in judged]
            columns = [pa.array([s for s, *_ in judged], pa.float64()), pa.array([int(s >= 0.5) for s, *_ in judged], pa.int32()), pa.array([e for _, e, _ in judged], pa.float64()), pa.array(passages, inner)]
            yield pa.RecordBatch.from_arrays([c for i, c in enumerate(batch.columns) if i != at] + columns, names=[c for i, c in enumerate(batch.schema.names) if i != at] + new)

    return kept.mapInArrow(lean(run), schema_with(kept.drop(source), ("score", "double"), ("predicted", "int"), ("evidence", "double"), ("passages", "array<struct<begin:int,end:int,score:double,expected:double>>")))
