"""Packing: every piece in a place of its own, few sequences; tokens as the library gives them."""

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from supplymesh.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def held(counts, capacity, **options):
    p = packing.plan(dict(counts), capacity, **options)
    length = np.repeat(np.array(sorted(counts), "i8"), [counts[k] for k in sorted(counts)])
    number = np.concatenate([np.arange(counts[k]) for k in sorted(counts)]).astype("i8") if counts else np.zeros(0, "i8")
    sequence, offset = p.places(length, number)
    places = {}
    for s, o, n in zip(sequence.tolist(), offset.tolist(), length.tolist()):
        places.setdefault(s, []).append((o, n))
    for own in places.values():
        at = 0
        for o, n in sorted(own):
            assert o == at
            at += n
        assert at <= capacity
    assert len(places) == p.sequences
    return p.sequences, -(-int(length.sum()) // capacity)


def test_plans():
    r = random.Random(2)
    for _ in range(80):
        most = r.choice([10, 40, 100])
        held(Counter(r.randint(1, most) for _ in range(r.randint(1, 800))), 100, groups=r.choice([2, 20, 128]))
    for most in (300, 700, 2048):
        used, least = held(Counter(min(2048, max(1, int(r.lognormvariate(6.3, 0.9)) % most + 1)) for _ in range(20_000)), 2048)
        assert used <= 1.02 * least + 1
    assert held({2048: 5, 1: 1}, 2048)[0] == 6
    assert packing.plan({}).sequences == 0
    with pytest.raises(ValueError):
        packing.plan({2049: 1})


@pytest.mark.parametrize("counts", [{1025: 1000, 1023: 1000}, {683: 999, 682: 2001}, {700: 1000, 698: 1000, 650: 1000}])
def test_few_lengths_are_not_rounded(counts):
    assert held(counts, 2048)[0] == 1000


def test_finer_groups_save_sequences():
    every = {k: 20 for k in range(1, 2049)}
    used, least = held(every, 2048)
    bigs = [k for k in range(2047, 256, -1)]
    coarse = packing._grouped(every, packing._equal_groups(every, bigs, -(-20 * len(bigs) // packing.GROUPS)), 2048, packing.LARGE)
    assert used <= 1.002 * least < 1.01 * least < coarse.sequences


def test_a_plan_does_not_grow_with_the_counts():
    r = random.Random(3)
    one = Counter(r.randint(1, 2048) for _ in range(5000))
    small, large = packing.plan(dict(one)), packing.plan({k: 10_000 * n for k, n in one.items()})
    assert len(large.length) < 4 * len(small.length) + 20_000


def test_documents(spark):
    from tokenizers import Tokenizer

    r = random.Random(4)
    texts = [None, "", " ", "a b", "x" * 9000, "don't  stop\n now\n\n", *("".join(r.choices("abc de\nf'é漢 ", k=r.randint(1, 6000))) for _ in range(60))]
    rows = [(i, t, 1) for i, t in enumerate(texts)] + [(3, "a b", 1), (None, "null id", 1)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string, length int"), PATH).collect()
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    want = []
    for k, text, _ in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        start, piece = 0, 0
        while start < len(ids):
            n = (len(ids) % 2048 or 2048) if not piece else 2048
            want.append((k, piece, start, n, zlib.crc32(np.array(ids[start : start + n], "<u4").tobytes())))
            start, piece = start + n, piece + 1
    key = lambda x: tuple(map(str, x))
    assert sorted((tuple(g)[:5] for g in got), key=key) == sorted(want, key=key)
    places = {}
    for g in got:
        places.setdefault(g.sequence_id, []).append((g.offset, g.length))
    for own in places.values():
        at = 0
        for o, n in sorted(own):
            assert o == at
            at += n
        assert at <= 2048
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_added_tokens():
    from tokenizers import Tokenizer

    texts = ["end <|endoftext|> begin", "<|endoftext|>", "plain text", "", "a <|endoftext b"]
    own = Tokenizer.from_file(PATH)
    assert [np.frombuffer(x, "<u4").tolist() for x in packing.encoded(PATH, texts)] == [own.encode(t, add_special_tokens=False).ids for t in texts]
    assert 50256 in np.frombuffer(packing.encoded(PATH, texts[:1])[0], "<u4")


def test_hot_lengths_are_split(spark, monkeypatch):
    monkeypatch.setattr(packing, "PART_ROWS", 7)
    rows = [(i, 0, 0, 10 if i % 3 else 20, i) for i in range(400)] + [(1, 0, 0, 10, 1)] * 5
    got = packing.place(spark.createDataFrame(rows, packing.PIECES), 100).collect()
    assert len({(g.sequence_id, g.offset) for g in got}) == len(rows)
