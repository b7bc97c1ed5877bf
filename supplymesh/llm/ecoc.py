"""Language identification by error-correcting output codes.

Each language has a codeword of bits. For each bit a binary classifier over hashed byte n-grams
tells languages with that bit set from the others. A text's bits are then decoded with losses: each
classifier's margin costs exp(-bit * margin), weighted by how often that classifier was right on
sampled documents of the language, and the codeword of least loss is chosen. The loss of the best
against that of the next codeword is the score; a text whose score is low is marked ambiguous.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from supplymesh.llm.common import crc_remainder, lean, prepare, sampled, schema_with, spare, stored

#: Hash buckets of n-grams, the orders of n-grams, documents sampled for each language, languages that can be told apart (more are an error).
BUCKETS, ORDERS, SAMPLE, LANGUAGES = 1 << 15, (2, 3, 4), 800, 4096
#: Score under which a text is ambiguous; what a language is called that can't be told.
AMBIGUOUS, UNKNOWN = 0.52, "und"
_SPACED = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
_RUNS = re.compile(rb" {2,}")


def ngrams(text: str) -> np.ndarray:
    """Hashed n-grams of the lower-cased text's UTF-8 bytes; ASCII other than letters is white space, whose runs are one space."""
    data = b" " + text.lower().encode("utf-8", "surrogatepass").translate(_SPACED) + b" "
    b = np.frombuffer(_RUNS.sub(b" ", data), "u1").astype("<u4")
    h, out = b * np.uint32(2654435761), []
    for n in range(2, max(ORDERS) + 1):
        if len(h) < 2:
            break
        h = (h[:-1] ^ b[n - 1 :]) * np.uint32(2246822519 + 2 * n)
        if n in ORDERS:
            out.append(h >> np.uint32(32 - BUCKETS.bit_length() + 1))
    return np.concatenate(out) if out else np.zeros(0, "<u4")


def codewords(languages: int, seed: int = 11) -> np.ndarray:
    """Bits (+1 or -1) by language and classifier: every way to split few languages in two, or of drawn codes the one of greatest least distance."""
    if languages < 2:
        return np.zeros((languages, 0), "i1")
    if languages <= 7:
        splits = [[1] + [1 if k >> i & 1 else -1 for i in range(languages - 1)] for k in range((1 << languages - 1) - 1)]
        return np.array(splits, "i1").T
    bits, draw = int(np.ceil(12 * np.log2(languages))), np.random.default_rng(seed)
    best, most = None, -1
    for _ in range(60 if languages <= 256 else 4):
        code = draw.choice(np.array([-1, 1], "i1"), (languages, bits))
        flat = np.abs(code.sum(axis=0)) == languages
        code[0, flat] *= -1
        own, least = code.astype("f4"), bits
        for i in range(1, languages):
            least = min(least, int(bits - (own[:i] @ own[i]).max()) // 2)
        if least > most:
            best, most = code, least
    return best


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    #: Weights of n-gram buckets by classifier; a classifier's margin is their mean over a text's n-grams.
    weights: np.ndarray
    #: What margins are divided by, and each classifier's share of right bits by language, adding up to 1.
    scale: np.ndarray
    trust: np.ndarray

    def margins(self, text: str) -> np.ndarray:
        h = ngrams(text)
        if len(h) > BUCKETS:
            return np.bincount(h, minlength=BUCKETS).astype("f4") @ self.weights / len(h)
        return self.weights[h].mean(axis=0) if len(h) else np.zeros(self.weights.shape[1], "f4")

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """The language, a score from 0 to 1, and whether it is ambiguous. No text or no letter: UNKNOWN, 0, ambiguous."""
        if not text or not self.languages or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0, True
        if len(self.languages) == 1:
            return self.languages[0], 1.0, False
        loss = (self.trust * np.exp(-self.code * np.clip(self.margins(text) / self.scale, -20, 20))).sum(axis=1)
        best, following = np.argsort(loss, kind="stable")[:2]
        score = float(loss[following] / (loss[best] + loss[following]))
        return self.languages[best], score, score < AMBIGUOUS


def fit(sample: DataFrame, languages: list[str], key: str = "lang", text: str = "text") -> Model:
    """A model from a bounded table of labelled texts, read twice. The driver gets counts by bucket and language, then sums of margins."""
    prepare(sample.sparkSession)
    languages = sorted(languages)
    code = codewords(len(languages))
    if len(languages) < 2:
        return Model(languages, code, np.zeros((BUCKETS, 0), "f4"), np.ones(0), np.ones((len(languages), 0)))
    index = {x: i for i, x in enumerate(languages)}
    base = sample.select(F.col(f"`{key}`").cast("string").alias("l"), F.col(f"`{text}`").alias("t"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for lang, body in zip(*(c.to_pylist() for c in batch.columns)):
                if lang in index and body:
                    own = sums.setdefault(index[lang], np.zeros(BUCKETS, "f8"))
                    h = np.bincount(ngrams(body), minlength=BUCKETS)
                    own += h / max(1, h.sum())  # each document counts alike, however long
        for i, own in sums.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), i, "i4")), pa.array(at.astype("i4")), pa.array(own[at])], names=["l", "h", "n"])

    def total(table: pa.Table) -> pa.Table:
        own = np.zeros(BUCKETS)
        np.add.at(own, table.column("h").to_numpy(), table.column("n").to_numpy())
        return pa.table({"l": pa.array([table.column("l")[0].as_py()], pa.int32()), "own": pa.array([((own + 1e-4) / (own + 1e-4).sum()).astype("<f8").tobytes()], pa.binary())})

    counted = base.mapInArrow(lean(count), "l int, h int, n double").groupBy("l", "h").agg(F.sum("n").alias("n"))
    sums = np.zeros((2, code.shape[1], BUCKETS))  # shares added up over the languages on either side of each classifier, a language at a time
    left = np.ones(len(languages), "?")
    for r in counted.groupBy("l").applyInArrow(total, "l int, own binary").toLocalIterator():
        sums[0, code[r.l] > 0] += np.frombuffer(r.own, "<f8")
        sums[1, code[r.l] < 0] += np.frombuffer(r.own, "<f8")
        left[r.l] = False
    for i in np.flatnonzero(left):  # languages of empty texts alone
        sums[0, code[i] > 0] += 1 / BUCKETS
        sums[1, code[i] < 0] += 1 / BUCKETS
    sides = np.stack([(code > 0).sum(axis=0), (code < 0).sum(axis=0)])[:, :, None]
    sums /= sides
    weights = np.ascontiguousarray((np.log(sums[0]) - np.log(sums[1])).T.astype("f4"))
    plain = Model(languages, code, weights, np.ones(code.shape[1]), np.ones(code.shape))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for lang, body in zip(*(c.to_pylist() for c in batch.columns)):
                if lang in index and body:
                    m = plain.margins(body)
                    rows.append((index[lang], [*((m * code[index[lang]]) > 0).astype(float).tolist(), *np.abs(m).astype(float).tolist()]))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.list_(pa.float64()))], names=["l", "v"])

    bits = code.shape[1]
    judged = base.mapInArrow(lean(judge), "l int, v array<double>").groupBy("l").agg(F.count("*").alias("n"), *(F.sum(F.col("v")[i]).alias(f"s{i}") for i in range(2 * bits))).collect()
    right, size, n = np.zeros(code.shape), np.zeros(bits), 0
    for r in judged:
        right[r.l] = [r[f"s{i}"] / r.n for i in range(bits)]
        size += [r[f"s{bits + i}"] for i in range(bits)]
        n += r.n
    trust = right + 1e-3
    return Model(languages, code, weights, np.maximum(size / max(1, n), 1e-6) / 2, trust / trust.sum(axis=1, keepdims=True))


def learn(docs: DataFrame, learned_from, key: str = "doc_id", lang: str = "lang", text: str = "text", sample: int = SAMPLE, languages: int = LANGUAGES) -> Model:
    """A model from documents for which ``learned_from`` (a boolean column) holds and whose language is known.

    About ``sample`` documents of each language are used, by a hash of their key: a documented bound, so that the driver's
    share stays the same for any corpus. Every language that occurs is learned; more than ``languages`` are an error. Texts are used whole.
    """
    known = docs.filter(learned_from & F.col(lang).isNotNull() & F.col(text).isNotNull())
    counts = known.groupBy(lang).agg(F.count("*").alias("n")).orderBy(F.desc("n"), lang).limit(languages + 1).collect()
    if len(counts) > languages:
        raise ValueError(f"more than {languages} languages: are these labels?")
    if not counts:
        return Model([], np.zeros((0, 0), "i1"), np.zeros((BUCKETS, 0), "f4"), np.ones(0), np.ones((0, 0)))
    share = F.create_map(*(F.lit(x) for r in counts for x in (r[lang], min(1.0, sample / r.n))))
    chosen = known.filter(sampled(key, F.coalesce(share[F.col(lang)], F.lit(0.0)), 5))
    return fit(stored(chosen.select(F.col(lang).alias("lang"), F.col(text).alias("text")), "languages"), [r[lang] for r in counts])


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with ``lang_pred``, ``score`` and ``ambiguous``, from the text alone. Columns of these names give way; no shuffle."""
    prepare(docs.sparkSession)
    new = ["lang_pred", "score", "ambiguous"]
    source = spare(docs, "__text")
    kept = docs.withColumn(source, F.col(f"`{text}`").cast("string")).drop(*(c for c in new))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by buckets and bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            at = batch.schema.get_field_index(source)
            rows = [own.predict(t) for t in batch.column(at).to_pylist()]
            columns = list(zip(*rows)) if rows else [[], [], []]
            yield pa.RecordBatch.from_arrays([c for i, c in enumerate(batch.columns) if i != at] + [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.float64(), pa.bool_()))], names=[n for i, n in enumerate(batch.schema.names) if i != at] + new)

    return kept.mapInArrow(lean(run), schema_with(kept.drop(source), ("lang_pred", "string"), ("score", "double"), ("ambiguous", "boolean")))


#: Documents whose crc32(doc_id) has this remainder are held out.
MODULUS, HELD_OUT = 4, 2


def held_out(key: str = "doc_id"):
    return crc_remainder(key, MODULUS) == HELD_OUT
