"""Fingerprints: hashes and boundaries against plain versions, neighbours against a list."""

import hashlib
import random

from supplymesh.llm import chunks


def test_gear_hashes_and_boundaries():
    r = random.Random(3)
    for n in (0, 1, 24, 25, 33, 500, 5000):
        data = bytes(r.choice(b"abcdefgh \xc3") for _ in range(n))
        h, plain = 0, []
        for b in data:
            h = ((h << 1) + int(chunks.GEAR[b])) & 0xFFFFFFFF
            plain.append(h)
        assert chunks.gear_hashes(data).tolist() == plain
        ends, start = [], 0
        while start < n:
            end = min(n, start + chunks.GREATEST)
            for i in range(start + chunks.LEAST, end + 1):
                if plain[i - 1] >> (32 - (chunks.BITS_BEFORE if i < start + chunks.USUAL else chunks.BITS_AFTER)) == 0:
                    end = i
                    break
            ends.append(end)
            start = end
        assert chunks.boundaries(data) == ends


def test_containment_survives_shifts():
    r = random.Random(5)
    text = " ".join("".join(r.choices("abcdefghij", k=r.randint(2, 9))) for _ in range(900))
    own = chunks.chunk_set(text.encode())
    assert chunks.parse(chunks.fingerprint(own)) == own
    assert chunks.containment(own, chunks.chunk_set(("inserted words " + text).encode())) > 0.95
    assert chunks.containment(own, chunks.chunk_set(text[: len(text) // 2].encode())) > 0.45
    assert chunks.containment(own, chunks.chunk_set(b"")) == 0 and chunks.containment({}, {}) == 1


def test_neighbours(spark):
    r = random.Random(7)
    rows = [(i, r.choice([None, "", "x", "é" * 50, "".join(r.choices("abc ", k=r.randint(1, 3000)))]), "clash") for i in range(0, 400, 3)]
    rows += [(9, rows[3][1], "dup"), (None, "nobody's text", None), (399, "z" * 200_000, None)]
    shuffled = rows[:]
    r.shuffle(shuffled)
    for size in (1 << 30, 3000):
        got = chunks.compare_neighbours(spark.createDataFrame(shuffled, "doc_id long, text string, fingerprint string"), bucket_chars=size).collect()
        order = sorted(((-1 if k is None else k), t or "") for k, t, _ in rows)
        want = []
        for i, (k, t) in enumerate(order):
            n = order[(i + 1) % len(order)][1]
            half = len(t) // 2
            edited = t[: len(t) - half] + n[:half]
            want.append((k, len(t), hashlib.sha256(edited.encode()).hexdigest()))
        assert sorted((-1 if g.doc_id is None else g.doc_id, g.n_chars, g.edited_sha256) for g in got) == sorted(want)
        by_text = {}
        for g in got:
            by_text.setdefault((g.n_chars, g.fingerprint), g)
            assert 0 <= g.near_edited <= 1 and 0 <= g.near_next <= 1


def test_one_row_and_none(spark):
    g = chunks.compare_neighbours(spark.createDataFrame([(1, "abcd")], "doc_id long, text string")).first()
    assert g.edited_sha256 == hashlib.sha256(b"abab").hexdigest() and g.near_next == 1.0
    assert chunks.compare_neighbours(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert chunks.fingerprint_column(spark.createDataFrame([(1, None, "c")], "doc_id long, text string, fingerprint string")).first().fingerprint == ""


def test_a_row_that_is_a_third_of_the_table(spark, monkeypatch):
    monkeypatch.setattr(chunks, "COPIES", 7)
    r = random.Random(2)
    words = lambda n: " ".join("".join(r.choices("abcdef", k=5)) for _ in range(n))
    rows = [(None, "the same text in very many rows")] * 60 + [(None, words(20)) for _ in range(30)] + [(i, words(30)) for i in range(60)] + [(5, words(9))] * 3
    got = [tuple(g) for g in chunks.compare_neighbours(spark.createDataFrame(rows, "doc_id long, text string"), bucket_chars=900).collect()]
    assert len(got) == len(rows)
    same = [g for g in got if g[0] is None and g[1] == len(rows[0][1])]
    assert len(same) == 60 and sum(g[6] == 1.0 for g in same) >= 59
    plain = {t: chunks.fingerprint(chunks.chunk_set(t.encode())) for _, t in rows}
    assert sorted(g[3] for g in got) == sorted(plain[t] for _, t in rows)
    texts = {chunks.fingerprint(chunks.chunk_set(t.encode())): t for _, t in rows}
    followed = [hashlib.sha256(chunks.spliced(a, b).encode()).hexdigest() for a in set(texts.values()) for b in set(texts.values())]
    assert {g[2] for g in got} <= set(followed)
