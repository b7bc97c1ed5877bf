"""Toxicity: segments against a brute-force version, held-out accuracy, odd inputs."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from supplymesh.llm import toxicity


def brute(scores):
    def rec(a, b):
        best = None
        for i in range(a, b):
            t = 0
            for j in range(i, b):
                t += scores[j]
                if t > 1e-9 and (best is None or t > best[0] + 1e-9):
                    best = (t, i, j + 1)
        return [] if best is None else rec(a, best[1]) + [best[1:]] + rec(best[2], b)

    return rec(0, len(scores))


def test_segments():
    r = random.Random(1)
    for _ in range(1500):
        s = [r.choice([r.uniform(0.1, 3), -r.uniform(0.1, 3)]) for _ in range(r.randint(0, 14))]
        assert [(a, b) for a, b, _ in toxicity.segments(s)] == brute(s)
    assert len(toxicity.segments([1.0, -2.0] * 100_000)) == 100_000


def corpus(n=600, seed=5):
    r = random.Random(seed)
    words = ["".join(r.choices("abcdefghijklmno", k=r.randint(2, 9))) for _ in range(3000)]
    bad = ["vile" + "".join(r.choices("xyz", k=3)) for _ in range(30)] + ["scum", "rot"]
    docs, labels = [], []
    for i in range(n):
        w = r.choices(words, k=r.randint(5, 200))
        toxic = int(r.random() < 0.2)
        for _ in range(r.randint(1, 6) if toxic else 0):
            w.insert(r.randrange(len(w)), r.choice(bad))
        docs.append((i, " ".join(w), "clash"))
        labels.append((i, toxic))
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = corpus()
    toxic = dict(labels)
    d = spark.createDataFrame(docs, "doc_id long, text string, score string")
    l = spark.createDataFrame(labels + [(3, None), (None, 1), (10, toxic[10])], "doc_id long, toxic int")
    model = toxicity.learn(d, l)
    got = toxicity.detect(d.withColumn("held_out", toxicity.held_out()), model).collect()
    assert all(g.held_out == (zlib.crc32(str(g.doc_id).encode()) % 5 == 0) for g in got)
    held = [g for g in got if g.held_out]
    assert sum(g.predicted == toxic[g.doc_id] for g in held) / len(held) > 0.95
    assert all((g.score >= 0.5) == bool(g.predicted) and 0 <= g.score <= 1 for g in got)
    for g in got:
        for p in g.passages:
            assert 0 <= p.begin < p.end and p.expected < 1


def test_odd_inputs(spark):
    docs, labels = corpus(200, 8)
    shape = "doc_id long, text string"
    model = toxicity.learn(spark.createDataFrame([d[:2] for d in docs], shape), spark.createDataFrame(labels, "doc_id long, toxic int"))
    odd = spark.createDataFrame([(1, None), (2, ""), (None, "scum " * 100_000), (3, "!!!"), (3, "!!!")], shape)
    got = toxicity.detect(odd, model).collect()
    assert len(got) == 5 and got[0].score == got[1].score < 0.5 and got[3] == got[4]
    assert toxicity.detect(spark.createDataFrame([], shape), model).count() == 0
    empty = toxicity.learn(odd, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.detect(odd, empty).filter("predicted = 1").count() == 0


def test_weights_rate_and_score_against_plain_versions():
    r = random.Random(3)
    for _ in range(200):
        n1, n0 = r.randint(1, 500), r.randint(1, 900)
        a, b = r.randint(0, n1), r.randint(0, n0)
        weight = toxicity.PRIOR * (n1 + n0)
        prior = weight * (a + b + 0.5) / (n1 + n0 + 1)
        x, y = a + prior, b + prior
        odds = math.log(x / max(n1 + weight - x, 0.5)) - math.log(y / max(n0 + weight - y, 0.5))
        want = max(0.0, odds - toxicity.ERRORS * math.sqrt(1 / x + 1 / y))
        assert toxicity.weigh(np.array([float(a)]), np.array([float(b)]), n1, n0)[0] == pytest.approx(want, abs=1e-9)
    scores, total = Counter({0.5: 30, 1.2: 10, 3.0: 2}), 1000.0
    rate = toxicity._rate(scores, total)
    mean = (total - sum(scores.values())) / total * math.exp(-rate * toxicity.COST) + sum(n / total * math.exp(rate * s) for s, n in scores.items())
    assert rate > 0 and mean == pytest.approx(1, abs=1e-6)
    model = toxicity.Model({"vile": 4.0, "rot": 2.5, "rott-": 1.0}, rate=1.3, size=0.4, intercept=-2.0, slope=1.7)
    text = "a vile rot b c d e f g h vile i rotten j k"
    words, said, values = text.split(), Counter(), []
    for w in words:
        value = max([model.weights.get(w, 0.0), *(model.weights.get(w[:n] + "-", 0.0) for n in toxicity.PREFIXES if len(w) > n)]) - toxicity.COST
        if value > 0:
            said[w] += 1
            value /= said[w]
        values.append(value)
    evidence = 0.0
    for begin, end in brute(values):
        expected = model.size * len(words) * math.exp(-model.rate * sum(values[begin:end]))
        evidence += -math.log(expected) if expected < 1 else 0.0
    score, found, _ = model.judge(text)
    assert found == pytest.approx(evidence) and score == pytest.approx(1 / (1 + math.exp(2.0 - 1.7 * math.log1p(evidence))))


def test_weights_as_columns(spark):
    r = random.Random(6)
    n1, n0 = 300, 700
    rows = [(r.randint(0, n1), r.randint(0, n0)) for _ in range(300)] + [(1, 0), (0, 0), (n1, 0), (0, n0)]
    got = spark.createDataFrame(rows, "a long, b long").select("a", "b", toxicity.weight_column(F.col("a"), F.col("b"), n1, n0).alias("w")).collect()
    for g in got:
        assert g.w == pytest.approx(toxicity.weigh(np.array([float(g.a)]), np.array([float(g.b)]), n1, n0)[0], abs=1e-9)


@pytest.mark.parametrize("n1, n0", [(1, 1), (1, 6000), (50, 6000), (4000, 6000), (4000, 1), (10**6, 10)])
def test_a_term_of_one_document_never_counts(n1, n0):
    assert toxicity.weigh(np.array([1.0]), np.array([0.0]), n1, n0)[0] == 0


def test_terms_are_all_that_pass(spark):
    """The model's weights against a plain count over the sampled documents."""
    docs, labels = corpus(400, 9)
    toxic = dict(labels)
    rows = [(t, toxic[i], i % toxicity.FOLDS) for i, t, _ in docs]
    model = toxicity.fit(spark.createDataFrame(rows, "text string, toxic int, fold int"), (sum(t == 0 for _, t in labels), sum(t == 1 for _, t in labels)))
    count = (Counter(), Counter())
    for t, k, _ in rows:
        count[k].update({x for w in set(t.split()) for x in toxicity.terms(w)})
    n = [sum(k == j for _, k, _ in rows) for j in (0, 1)]
    want = {t: float(toxicity.weigh(np.array([float(c)]), np.array([float(count[0][t])]), n[1], n[0])[0]) for t, c in count[1].items()}
    assert model.weights == pytest.approx({t: w for t, w in want.items() if w > toxicity.COST}) and len(model.weights) > 10


def test_no_rate():
    assert toxicity._rate(Counter({2.0: 100}), 100.0) == toxicity.SLOWEST


def test_helper_columns_do_not_clash(spark):
    docs, labels = corpus(60, 2)
    d = spark.createDataFrame([(i, t, "mine", "yours") for i, t, _ in docs], "doc_id long, text string, __text string, __TEXT_ string")
    got = toxicity.detect(d, toxicity.Model({"scum": 3.0}))
    assert got.columns[:4] == d.columns and {(r["__text"], r["__TEXT_"]) for r in got.collect()} == {("mine", "yours")}
