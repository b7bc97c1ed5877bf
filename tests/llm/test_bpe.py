"""Byte-level BPE against tiktoken."""

import base64
import hashlib
import random
import time

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from supplymesh.llm import bpe
from supplymesh.llm.pretokens import ChunkMemory

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd_texts(n=3000):
    r = random.Random(1)
    texts = ["".join(r.choice("ab  \n\t\r\x85\xa0'sA1é漢  x<|endoftext|>") for _ in range(r.randint(0, 60))) for _ in range(n)]
    return texts + ["a" * 5000, "ab" * 3000, " ", "", "  x", " x", "x ", "x \n y", "x\n y", "don't  do", "y" * 70 + " " + "z" * 100 + " end"]


def test_like_the_library(library):
    own = bpe.BytePairEncoder.load(PATH, public_tokenizers.PATTERN)
    memory = ChunkMemory(own.encode_many, entries=500)
    texts = odd_texts()
    for part in (texts, texts[::-1]):
        for text, ids in zip(part, memory.encode(part)):
            assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text), text
            assert own.decode(ids) == text.encode()


def test_queue():
    r = random.Random(2)
    q, held = bpe.RankQueue(300_000), []
    for _ in range(5000):
        if r.random() < 0.6:
            x = (r.choice([r.randrange(300_000), r.randrange(5)]), r.randrange(50))
            held.append(x)
            q.push(*x)
        elif held:
            assert q.pop() == min(held)
            held.remove(min(held))
    while held:
        assert q.pop() == min(held)
        held.remove(min(held))
    assert q.pop() is None


def test_long_pretokens_take_little_longer_than_their_length():
    own = bpe.BytePairEncoder.load(PATH, public_tokenizers.PATTERN)
    r = random.Random(3)
    data = "".join(r.choices("abcdefgh", k=200_000)).encode()
    began = time.process_time()
    ids = own.merge(data)
    assert time.process_time() - began < 20 and own.decode(np.array(ids, "<u4").tobytes()) == data


def test_columns(spark, library):
    rows = [(i, t, b"clash") for i, t in enumerate(odd_texts(100))] + [(1000, None, None), (1001, "w " * 50_000, None), (0, "again", None)]
    df = bpe.encode_column(spark.createDataFrame(rows, "doc_id long, text string, ids binary"), "text", PATH, public_tokenizers.PATTERN, "ids", "decoded")
    got = df.collect()
    assert len(got) == len(rows)
    for g in got:
        text = g.text or ""
        assert np.frombuffer(g.ids, "<u4").tolist() == library.encode_ordinary(text)
        assert hashlib.sha256(g.decoded).digest() == hashlib.sha256(text.encode()).digest()
    again = bpe.decode_column(df.select("doc_id", "ids"), "ids", PATH, public_tokenizers.PATTERN).first()
    assert again.decoded is not None
    assert bpe.encode_column(spark.createDataFrame([], "text string"), "text", PATH, public_tokenizers.PATTERN).count() == 0
