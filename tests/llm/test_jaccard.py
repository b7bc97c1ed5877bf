"""The Jaccard join against a brute-force version."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from supplymesh.llm import jaccard
from supplymesh.llm.shingles import shingle_sets


def brute_set(text):
    words = [w.translate({i: i + 32 for i in range(65, 91)}) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)] if words else [])


def brute(rows):
    sets = {i: brute_set(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    lists = defaultdict(list)
    for i in sorted(sets):
        shared = Counter(j for s in sets[i] for j in lists[s])
        for s in sets[i]:
            lists[s].append(i)
        for j, o in shared.items():
            if 100 * o >= 80 * (len(sets[i]) + len(sets[j]) - o):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_shingles():
    r = random.Random(1)
    texts = ["".join(r.choice("ab \n\tAé\x85\xa0") for _ in range(r.randint(0, 60))) for _ in range(800)] + ["", "  ", None, "a", "a b c d e", "A B c d E f"]
    sets, plain = shingle_sets(texts), [brute_set(t) for t in texts]
    assert [len(s) for s in sets] == [len(b) for b in plain]
    for _ in range(20_000):
        i, j = r.randrange(len(texts)), r.randrange(len(texts))
        assert len(np.intersect1d(sets[i], sets[j])) == len(plain[i] & plain[j])


def test_bounds():
    for a in range(1, 60):
        for b in range(1, 60):
            c = jaccard.overlap_needed(a, b)
            assert (100 * c >= 80 * (a + b - c)) and not (100 * (c - 1) >= 80 * (a + b - c + 1))
            if c <= min(a, b):
                assert b in jaccard.partner_sizes(a)
    assert jaccard.boundary({}) >= 0 and jaccard.boundary({14: 1000}) < 14


def families(seed, short):
    r = random.Random(seed)
    words = ["".join(r.choices("abcdefghijklmnop", k=r.randint(2, 6))) for _ in range(400)]
    passage = r.choices(words, k=30)
    texts = []
    for _ in range(14):
        base = r.choices(words, k=r.randint(4, 22) if short else r.randint(20, 200))
        for _ in range(r.choice([1, 2, 5, 45])):
            own = base[:]
            for _ in range(r.randint(0, max(1, len(own) // 25))):
                i = r.randrange(len(own))
                own[i : i + 1] = r.choice([[r.choice(words)], [], [r.choice(words), r.choice(words)]])
            if r.random() < 0.2:
                own += passage
            texts.append(" ".join(own))
    return texts


@pytest.mark.parametrize("seed,short", [(1, True), (2, False), (3, True), (4, False)])
def test_against_brute_force(spark, monkeypatch, seed, short):
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 9)
    texts = families(seed, short) + [None, "", "   ", "one two", "ONE two", "long " * 60_000]
    order = list(range(len(texts)))
    random.Random(seed).shuffle(order)
    rows = [(k, texts[i]) for k, i in enumerate(order)]
    got = jaccard.joined(spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, size string")).collect()
    assert {g.doc_id: (g.n_shingles, g.component_id) for g in got} == brute(rows) and len(got) == len(rows)


def test_repeated_and_null_ids(spark):
    text = "the same few words in every row here"
    got = jaccard.joined(spark.createDataFrame([(3, text), (3, text), (None, text), (None, None), (7, "other")], "doc_id long, text string")).collect()
    assert sorted((str(g.doc_id), g.n_shingles, str(g.component_id)) for g in got) == [("3", 4, "3"), ("3", 4, "3"), ("7", 1, "7"), ("None", 0, "None"), ("None", 4, "3")]


@pytest.mark.parametrize("length,light", [(9, 32), (120, 32), (120, 1)])
@pytest.mark.parametrize("shared", [None, 50, 0])
def test_different_texts_with_one_id(spark, monkeypatch, shared, length, light):
    monkeypatch.setattr(jaccard, "LIGHT", light)
    a, b, c = (" ".join(f"{x}{i}" for i in range(length)) for x in "abc")
    rows = [(1, a + " tail"), (shared, a), (2, b + " tail"), (shared, b), (shared, c), ((1 << 63) - 1, "alone")]
    got = jaccard.joined(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    ids = [x for x in (1, shared) if x is not None], [x for x in (2, shared) if x is not None]
    want = [(1, min(ids[0])), (shared, min(ids[0])), (2, min(ids[1])), (shared, min(ids[1])), (shared, shared), ((1 << 63) - 1, (1 << 63) - 1)]
    assert sorted(map(str, ((g.doc_id, g.component_id) for g in got))) == sorted(map(str, want))


def test_empty(spark):
    assert jaccard.joined(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components(spark):
    r = random.Random(9)
    links = [(i, i + 1) for i in range(60)] + [(r.randrange(100, 200), r.randrange(100, 200)) for _ in range(60)]
    got = {x.u: x.component for x in jaccard.components(spark.createDataFrame(links, "u long, v long")).collect()}
    root = {x: x for e in links for x in e}
    for _ in range(200):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {k: v for k, v in root.items() if any(k in e and e[0] != e[1] for e in links)}


@pytest.mark.parametrize("power", [3, 5, 9, 10, 12])
def test_words_that_repeat_themselves(power):
    """A word of 2^power bytes and the one with its two letters exchanged, on which polynomial hashes modulo 2^64 agree."""
    a = "a"
    for _ in range(power):
        a += a.translate({97: 98, 98: 97})
    b = a.translate({97: 98, 98: 97})
    sets = shingle_sets([a, b, a + " w x y z", b + " w x y z"])
    assert len({int(s[0]) for s in sets}) == 4


def test_many_null_ids(spark):
    r = random.Random(8)
    texts = [" ".join(f"{k}x{i}" for i in range(30)) for k in range(40)]
    rows = [(i, t + " tail") for i, t in enumerate(texts[:20])] + [(None, r.choice(texts)) for _ in range(300)]
    got = jaccard.joined(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(g.doc_id for g in got if g.doc_id is not None) == list(range(20)) and all(g.component_id == g.doc_id for g in got if g.doc_id is not None)
    want = Counter(texts.index(t) if texts.index(t) < 20 else None for i, t in rows if i is None)
    assert Counter(g.component_id for g in got if g.doc_id is None) == want


@pytest.mark.parametrize("hot", [1, 3])
def test_hot_keys_and_chained_families(spark, monkeypatch, hot):
    """Lists that chain many groups, each cut where that is cheaper, with every key counted as hot, some and hardly any."""
    monkeypatch.setattr(jaccard, "HOT", hot)
    monkeypatch.setattr(jaccard, "LIGHT", 2)
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 4)
    r = random.Random(hot)
    passages = [[f"p{k}w{i}" for i in range(12)] for k in range(8)]
    texts = []
    for k in range(8):
        for n in range(9):
            own = passages[k] + (passages[(k + 1) % 8] if n == 0 else []) + [f"d{k}v{r.randrange(3)}" for _ in range(r.randint(0, 3))]
            texts.append(" ".join(own))
    rows = list(enumerate(texts))
    got = jaccard.joined(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {g.doc_id: (g.n_shingles, g.component_id) for g in got} == brute(rows)


@pytest.mark.parametrize("few, hot", [(10_000, 1000), (0, 10), (0, 2), (0, 1)])
def test_looked_up_by_each_way(spark, monkeypatch, few, hot):
    """Broadcast whole, hot keys apart, or a plain join: the same rows. Keys that aren't found, null keys and an empty table give none."""
    monkeypatch.setattr(jaccard, "FEW", few)
    monkeypatch.setattr(jaccard, "HOT", hot)
    given = [(k, i) for k, n in ((1, 60), (2, 20), (3, 1), (4, 7)) for i in range(n)] + [(None, 1), (9, 1)]
    rows = spark.createDataFrame(given, "k long, i long")
    found = spark.createDataFrame([(1, 60, "a"), (2, 20, "b"), (3, 1, "c"), (4, 7, "d"), (5, 0, "e")], "k long, n long, x string")
    got = sorted(tuple(r) for r in jaccard.looked_up(rows, found, ["k"]).select("k", "i", "x").collect())
    assert got == sorted((k, i, "abcd"[k - 1]) for k, i in given if k in (1, 2, 3, 4))
    assert jaccard.looked_up(rows, found.limit(0), ["k"]).count() == 0 and jaccard.looked_up(rows.limit(0), found, ["k"]).count() == 0
