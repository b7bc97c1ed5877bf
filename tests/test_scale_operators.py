"""Operators with joins, indexes and merges of their own against plain versions."""

import difflib
import random
import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from supplymesh.operators import asof, discovery, fuzzy, graph, phrases, relational
from supplymesh.plans import control
from supplymesh.sources import tables


def in_turn(edges, root, limits):
    """(name, tier, parent) by parents that choose one after the other, in one process."""
    by = {}
    for seq, (source, name, confidence) in enumerate(edges):
        by.setdefault(source, []).append((-confidence, seq, name))
    seen, out, level, popped = {root}, [], [root], 0
    for tier in range(1, max(1, limits.max_depth) + 1):
        following = []
        for parent in level:
            if limits.total is not None and popped >= limits.total:
                return out
            popped += 1
            taken = 0
            for _, _, name in sorted(by.get(parent, [])):
                if taken == limits.per_parent:
                    break
                if name not in seen:
                    seen.add(name)
                    taken += 1
                    out.append((name, tier, parent))
                    if limits.queue is None or len(following) < limits.queue:
                        following.append(name)
        level = following
    return out


@pytest.mark.parametrize("seed, limits", [(1, graph.Limits(4, 3, 6, 9)), (2, graph.Limits(3, 4, None, None)), (3, graph.Limits(2, None, None, None))])
def test_deferred_acceptance_is_taking_turns(spark, seed, limits):
    r = random.Random(seed)
    names = ["R", *(f"N{i}" for i in range(40))]
    edges = [(r.choice(names[:25]), r.choice(names), r.choice((0.9, 0.8, 0.7))) for _ in range(400)] + [("R", f"N{i}", 0.95) for i in range(6)]
    df = spark.createDataFrame([(s, n, c, i) for i, (s, n, c) in enumerate(edges)], "source string, name string, confidence double, seq long")
    got = graph.expand_tiers(df, "R", limits).orderBy("seq").collect()
    assert [(x["name"], x["tier"], x["parent"]) for x in got] == in_turn(edges, "R", limits)
    assert [x["seq"] for x in got] == list(range(len(got))) and all(x["path"][-2:] == [x["parent"], x["name"]] for x in got)


def test_closest_names_are_those_of_all_pairs(spark):
    r = random.Random(4)
    words = ["taiwan", "semi", "conductor", "works", "müller", "gmbh", "aaaa", "abab", "x"]
    keys = sorted({" ".join(r.choice(words) for _ in range(r.randint(1, 4))) for _ in range(60)})
    typed = []
    for k in keys:
        c = list(k)
        for _ in range(r.randint(0, 3)):
            i = r.randrange(len(c))
            c[i : i + 1] = r.choice([[], [c[i], c[i]], ["q"], c[i : i + 1]])
        typed.append("".join(c))
    typed += ["", None, "nothing like it", typed[3]]
    names, known = spark.createDataFrame([(t,) for t in typed], "name string"), spark.createDataFrame([(k,) for k in [*keys, keys[0], None, ""]], "key string")
    got = {x["name"]: x["key"] for x in fuzzy.closest(names, known, 0.8).collect()}
    wanted = {t: difflib.get_close_matches(t, keys, n=1, cutoff=0.8) for t in typed if t}
    assert got == {t: k[0] for t, k in wanted.items() if k}
    pairs = fuzzy.candidates(names, known, 0.8)
    assert pairs.count() == pairs.distinct().count() < len(set(typed)) * len(keys) / 5


def test_numbered_names_are_mostly_done_after_one_join(spark, monkeypatch):
    keys = [f"Supplier#{i:09}" for i in range(300)]
    typed = [k[:-2] + k[-1] + k[-2] * 2 for k in keys] + ["upplier#000000123", "Supplier#0000001234\0", "Suppliers#000000222", "S😀upplier#000000111", "Splier#00000007", "x", keys[5]]
    looked, search = [], fuzzy.candidates
    monkeypatch.setattr(fuzzy, "candidates", lambda names, known, cutoff: (looked.append(names.count()), search(names, known, cutoff))[1])
    got = {x["name"]: (x["key"], x["ratio"]) for x in fuzzy.closest(spark.createDataFrame([(t,) for t in typed], "name string"), spark.createDataFrame([(k,) for k in keys], "key string")).collect()}
    wanted = {t: difflib.get_close_matches(t, keys, n=1, cutoff=0.88) for t in typed}
    assert {t: k for t, (k, _) in got.items()} == {t: k[0] for t, k in wanted.items() if k} and looked[0] < 10
    assert all(r == difflib.SequenceMatcher(None, k, t).ratio() for t, (k, r) in got.items())


def test_most_likeness_is_that_of_the_longest_common_subsequence(monkeypatch):
    monkeypatch.setattr(fuzzy, "AT_ONCE", 50)
    r = random.Random(5)
    pairs = [("".join(r.choice("ab😀\0") for _ in range(r.randint(1, 20))), "".join(r.choice("ab😀\0") for _ in range(r.randint(1, 20)))) for _ in range(200)]

    def common(a, b):
        row = [0] * (len(a) + 1)
        for c in b:
            new = [0]
            for i, x in enumerate(a):
                new.append(max(new[i], row[i + 1], row[i] + (x == c)))
            row = new
        return row[-1]

    got = fuzzy.most_likeness(pd.Series([a for a, _ in pairs]), pd.Series([b for _, b in pairs]))
    assert list(got) == [2.0 * common(a, b) / (len(a) + len(b)) for a, b in pairs]
    assert all(x >= difflib.SequenceMatcher(None, b, a).ratio() for x, (a, b) in zip(got, pairs))


def plain_mentions(texts, dictionary):
    out = set()
    for i, t in texts:
        words = [(m[0].lower(), m.start(), m.end()) for m in re.finditer(r"[^\W_]+", t or "")]
        for p, phrase in dictionary:
            w = [m[0].lower() for m in re.finditer(r"[^\W_]+", phrase or "")]
            out |= {(i, p, j, words[j][1], words[j + len(w) - 1][2]) for j in range(len(words) - len(w) + 1) if w and [x[0] for x in words[j : j + len(w)]] == w}
    return out


@pytest.mark.parametrize("most", [None, 0])
def test_mentions_and_directions(spark, monkeypatch, most):
    r = random.Random(6)
    words = ["The", "the", "Österreich", "chip", "maker", "to", "a", "b_c", "中文", "7nm"]
    texts = [(i, "".join(r.choice(words) + r.choice([" ", ", ", "-", "\n"]) for _ in range(r.randint(0, 80)))) for i in range(60)] + [(900, None), (901, "the " * 3000)]
    dictionary = [("a", "the the"), ("b", "Chip  maker"), ("c", "a a a"), ("d", "absent"), ("e", "the absent"), ("f", "?!"), ("g", None), ("h", "österreich THE chip"), ("i", "7nm")]
    if most is not None:
        monkeypatch.setattr(phrases, "BROADCAST_WORDS", most)
        monkeypatch.setattr(phrases, "HOT", 20)
    docs, known = spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame(dictionary, "phrase_id string, phrase string")
    found = phrases.mentions(docs, known, "id", "text")
    got = [tuple(x) for x in found.collect()]
    assert len(got) == len(set(got)) and set(got) == plain_mentions(texts, dictionary)
    if most is None:
        short = [x for x in got if x[0] < 900]
        links = [(i, m[0].lower(), m.start(), m.end()) for i, t in texts for m in re.finditer(r"[^\W_]+", t or "") if m[0].lower() == "to"]
        near = lambda x, y: 0 <= y - x <= 9
        wanted = sorted((c[0], c[1], s[1], "to") for c in short for k in links if k[0] == c[0] and near(c[4], k[2]) for s in short if s[0] == c[0] and near(k[3], s[3]) and s[1] != c[1])
        told = phrases.directed(found.filter("id < 900"), phrases.word_positions(docs, "id", "text", frozenset(["to"])), 9)
        assert sorted(map(tuple, told.collect())) == wanted and len(wanted) > 10


def test_bands_have_both_sides_of_a_border(spark):
    a = spark.createDataFrame([(1, s, s + 3) for s in range(0, 60)], "id int, start int, end int")
    got = {(x["left"]["start"], x["right"]["start"]) for x in phrases.within(a, a, 7).collect()}
    assert got == {(s, t) for s in range(60) for t in range(60) if 0 <= t - (s + 3) <= 7}


@pytest.mark.parametrize("equal", [True, False])
def test_as_of_join(spark, equal):
    r = random.Random(8)
    right = [(r.choice([1, 1, 1, 2, 3, None]), r.choice([*range(50), None]), i, r.choice(["x", None])) for i in range(300)]
    left = [(i, r.choice([1, 1, 1, 1, 2, 3, 4, None]), r.choice([*range(-2, 55), None]), "mine") for i in range(400)] + [(0, 1, 7, "mine")]
    a = spark.createDataFrame(left, "id int, k int, t int, v string")
    b = spark.createDataFrame(right, "k int, u int, n int, v string")
    got = asof.asof_join(a, b, "k", "t", "u", ["n", "v"], ties=["n"], allow_equal=equal)
    assert got.columns == ["id", "k", "t", "n", "v"]
    wanted = []
    for i, k, t, _ in left:
        fits = [x for x in right if None not in (k, t, x[0], x[1]) and x[0] == k and (x[1] <= t if equal else x[1] < t)]
        best = max(fits, key=lambda x: (x[1], x[2]), default=(None,) * 4)
        wanted.append((i, k, t, best[2], best[3]))
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, wanted))
    assert [x["n"] for x in asof.asof_join(a, b.limit(0), "k", "t", "u", ["n"]).select("n").distinct().collect()] == [None]


def test_merging_groups(spark):
    r = random.Random(9)
    rows = [(r.choice(["hot", "hot", "a", None]), i, r.choice(["x", "y", "", None, "Unknown"]), [r.choice("pqr") for _ in range(r.randint(0, 3))], r.choice([1, 5, None])) for i in r.sample(range(1000), 200)]
    df = spark.createDataFrame([(*x, x[2]) for x in rows], "k string, o int, s string, items array<string>, n int, f string").repartition(4)
    got = {x["k"]: x for x in relational.merge_groups(df, "k", "o", unions=["items"], maxima=["n"], joined={"s": "; "}, firsts={"f": "Unknown"}).collect()}
    for key in ("hot", "a", None):
        own = sorted((x for x in rows if x[0] == key), key=lambda x: x[1])
        told = [x[2] for x in own if x[2]]
        assert got[key]["members"] == len(own) and got[key]["n"] == max(x[4] for x in own if x[4] is not None)
        assert got[key]["items"] == sorted({i for x in own for i in x[3]}) and got[key]["s"] == "; ".join(dict.fromkeys(told))
        assert got[key]["f"] == next((x for x in told if x != "Unknown"), own[0][2])


def test_observed_budget(spark):
    rows = spark.createDataFrame([(i % 3, i) for i in range(20)], "k int, o int")
    kept, audit = control.observed_budget(rows, "k", ["o"], 4)
    assert kept.count() == 12 and [tuple(x) for x in audit.collect()] == [(20, 12, 8)]


def test_layers_of_files(spark, tmp_path):
    firm = lambda *names: "[" + ", ".join(f'{{"name": "{n}"}}' for n in names) + "]"
    files = {
        "curated": [("A", firm("Curated Chips"))],
        "cache-0": [("A", firm("New Chips")), ("B", firm("New Chips", "Second Optics")), ("C", "[]"), ("G", '[{"name": null}]')],
        "cache-1": [("C", firm("Old Chips")), ("D", "not json"), ("F", firm("Old Chips"))],
        "cache-10": [("D", firm("Oldest Chips")), ("F", firm("Oldest Chips"))],
        "live": [(c, firm("Live Chips")) for c in "ABCDEFG"],
    }
    for layer, rows in files.items():
        spark.createDataFrame(rows, "company string, payload string").write.parquet(f"{tmp_path}/{layer}")
    read = tables.versioned_files(spark, str(tmp_path))
    told = lambda how: {(x["company"], x["seq"]): (x["layer"], x["name"]) for x in discovery.layered_files(read, how).collect()}
    live = ("live", "Live Chips")
    assert told(discovery.Layers()) == {("A", 0): ("curated", "Curated Chips"), ("B", 0): ("cache-0", "New Chips"), ("B", 1): ("cache-0", "Second Optics"), ("C", 0): live, ("D", 0): ("cache-10", "Oldest Chips"), ("E", 0): live, ("F", 0): ("cache-1", "Old Chips"), ("G", 0): live}
    assert set(told(discovery.Layers(refresh=True)).values()) == {live}
    assert told(discovery.Layers(prefer_curated=False, cache_only=True)).keys() == {("A", 0), ("B", 0), ("B", 1), ("D", 0), ("F", 0)}


def test_alias_lookup_of_repeated_rows(spark):
    left = spark.createDataFrame([(1, ["A Inc", "b"]), (2, ["A Inc", "b"]), (2, ["A Inc", "b"]), (3, ["z", ""]), (4, None)], "id int, names array<string>")
    right = spark.createDataFrame([(10, ["a inc"], 1), (11, ["B", "q"], 2), (12, [""], 3)], "r int, n array<string>, o int")
    got = sorted((x["id"], x["match"] and x["match"]["r"]) for x in control.alias_lookup(left, right, "names", "n", "o").collect())
    assert got == [(1, 11), (2, 11), (2, 11), (3, None), (4, None)]
    assert "monotonically" not in control.alias_lookup(left, right, "names", "n", "o")._jdf.queryExecution().toString()
