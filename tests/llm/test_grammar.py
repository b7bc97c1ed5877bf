"""Secret scans against plain versions of the patterns, the automata and the scores."""

import hashlib
import math
import random
import re
import string

import pytest

from supplymesh.llm import grammar
from supplymesh.llm.queries import op11_grammar_secrets

HEXES = "0123456789abcdef"


def plain_base(text):
    """(kind, start, end) by the patterns as they are given, one kind after the other."""
    found = []
    for kind, pattern, least, group in (("assign", r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?[ ]*[:=][ ]*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2), ("access", "AKIA[A-Z0-9]+", 20, 0), ("hex", "[0-9a-f]+", 24, 0)):
        found += [(m.start(), grammar.KINDS.index(kind), m.end()) for m in re.finditer(pattern, text) if len(m[group]) >= least]
    return [(grammar.KINDS[k], s, e) for s, k, e in sorted(found)]


def hexes(r, n):
    return "".join(r.choice(HEXES) for _ in range(n))


def access(r):
    return "AKIA" + "".join(r.choice(string.ascii_uppercase + string.digits) for _ in range(16))


def prose(r, n):
    return " ".join("".join(r.choice("etaoinshrdlu") for _ in range(r.randint(2, 17))) for _ in range(n))


def test_base_spans():
    r = random.Random(1)
    pieces = ["token=", "TOKEN : ", "api_key='", 'ApiKey":"', "passwd", "ſecret=", "Kelvin toKen=abcdefg", "secret =  ", "\ttoken\t=x", hexes(r, 23), hexes(r, 24), hexes(r, 60).upper(), access(r), access(r)[:19], "AKIA", "ü", "😀", " ", "abc12", "a=b=c.d/e", "password=secret=abcdef", '"', "\n"]
    for _ in range(3000):
        text = "".join(r.choice(pieces) for _ in range(r.randint(0, 12)))
        base = grammar.base_spans(text)
        assert [(grammar.KINDS[k], s, e) for s, k, e, _ in base] == plain_base(text)
        taken = {i for _, s, e in plain_base(text) for i in range(s, e)}
        runs = [m.span() for m in re.finditer("[A-Za-z0-9+/_.=-]+", text) if m.end() - m.start() >= 12]
        assert grammar.candidates(text, base) == [(s, e) for s, e in runs if not taken & set(range(s, e))]
    assert grammar.base_spans("ſecret=abcdefgh Key") == []


def test_automaton_keeps_literals_and_is_a_distribution():
    r = random.Random(2)
    keys = [access(r) for _ in range(600)]
    a = grammar.infer(keys)
    code = {c: i for i, c in enumerate(grammar.SYMBOLS)}
    state = 1
    for c in "AKIA":
        assert math.exp(a.log[state, code[c]]) > 0.9
        state = a.move[state, code[c]]
    assert max(a.log[state, code[c]] for c in "ABC") < math.log(0.1)  # what follows is random
    assert len(a.move) < 60
    assert pytest.approx(1) == float(__import__("numpy").exp(a.log).sum(1)[1])

    def one(s):
        at, total = 1, 0.0
        for c in s:
            total += a.log[at, code.get(c, grammar.END)]
            at = a.move[at, code.get(c, grammar.END)]
        return total + a.log[at, grammar.END]

    tried = [*keys[:20], "AKIA", "", "x", "AKIA" + "Q" * 5000, "Z", *(prose(r, 1) for _ in range(30))]
    assert a.logs(tried).tolist() == pytest.approx([one(s) for s in tried])
    assert a.logs([]).tolist() == []
    whole = grammar.infer(["ab", "ab", "a"] * 200)
    chances = {s: math.exp(whole.logs([s])[0]) for s in ("ab", "a", "b", "")}
    assert chances["ab"] == pytest.approx(2 / 3, abs=0.02) and chances["a"] == pytest.approx(1 / 3, abs=0.02) and chances["b"] < 0.01


def test_merging_is_by_hoeffdings_bound():
    tree = grammar._Tree(["a" * 3] * 100 + ["b"] * 100)
    assert not tree.alike(0, tree.child[0][0 + grammar.SYMBOLS.index("b")], 1.0)
    r = random.Random(3)
    loop = grammar._Tree([hexes(r, 24) for _ in range(500)])
    child = loop.child[0][grammar.SYMBOLS.index("a")]
    before = loop.seen[0] + loop.seen[child]
    assert loop.alike(0, child, math.sqrt(0.5 * math.log(2 / grammar.CHANCE)))
    loop.fold(0, child)
    assert loop.seen[0] == before


def corpus(r):
    rows = [prose(r, 60) for _ in range(150)]
    for i in range(40):
        rows.append(f"{prose(r, 20)} token = \"{hexes(r, 40)}\" {prose(r, 5)}")
        rows.append(f"{prose(r, 20)} {access(r)} {prose(r, 5)} password={hexes(r, 18)}")
    return rows


def test_scan(spark):
    r = random.Random(4)
    texts = [*corpus(r), None, "", "mail7.example.com " + prose(r, 3), "é" * 50 + " " + hexes(r, 22) + " 😀", "k" * 200_000, f"{access(r)[:19]} {prose(r, 2)}"]
    unlabelled = len(texts) - 3
    df = spark.createDataFrame([(i, t, "clash", "mine") for i, t in enumerate(texts)] + [(None, texts[0], None, None)], "doc_id long, text string, spans string, row string").repartition(3)
    model = grammar.learn(df)
    got = grammar.scan(df, model).collect()
    assert len(got) == len(texts) + 1 and got[0].asDict().keys() == {"doc_id", "text", "row", "spans"}
    pairs, count = {}, 0
    for t in [*texts, texts[0]]:
        base = [(grammar.KINDS.index(k), s, e) for k, s, e in plain_base(t or "")]
        taken = {i for _, s, e in base for i in range(s, e)}
        for m in re.finditer("[A-Za-z0-9+/_.=-]{12,}", t or ""):
            if not taken & set(range(*m.span())):
                count += 1
                c = [grammar.END, *(grammar.SYMBOLS.index(x) for x in m[0]), grammar.END]
                for p in zip(c, c[1:]):
                    pairs[p] = pairs.get(p, 0) + 1
    assert model.least == pytest.approx(math.log(count / grammar.EXPECTED))

    def ratio(a, s):
        total, at, before = 0.0, 1, grammar.END
        for c in [*(grammar.SYMBOLS.index(x) for x in s), grammar.END]:
            if at:
                total += a.log[at, c] - math.log((pairs.get((before, c), 0) + 1) / (sum(v for (x, _), v in pairs.items() if x == before) + grammar.END + 1))
            at, before = a.move[at, c], c
        return total

    for g in got:
        t = g["text"] or ""
        base = plain_base(t)
        assert [(s["kind"], s["start"], s["end"]) for s in g["spans"] if s["kind"] != "format"] == base
        taken = {i for _, s, e in base for i in range(s, e)}
        more = []
        for m in re.finditer("[A-Za-z0-9+/_.=-]{12,}", t):
            if len(m[0]) < 500 and not taken & set(range(*m.span())):
                score = math.log(sum(math.exp(ratio(a, m[0])) for a in model.automata) / len(model.automata))
                assert abs(score - model.least) > 1e-6
                if score >= model.least:
                    more.append(m.span())
        assert [(s["start"], s["end"]) for s in g["spans"] if s["kind"] == "format"] == more
        assert g["spans"] == sorted(g["spans"], key=lambda s: (s["start"], grammar.KINDS.index(s["kind"])))
    of = {g["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in g["spans"]] for g in got}
    assert of[unlabelled] == [("format", 51, 73)]  # too short for a base pattern, and no word before it
    assert [s[0] for s in of[len(texts) - 1]] == ["format"]  # an access key that lacks a character
    assert all(not of[i] for i in range(150)) and not of[unlabelled - 1]


def test_without_labels_or_rows(spark):
    df = spark.createDataFrame([(1, "no secret here, only prose"), (2, None)], "doc_id long, text string")
    model = grammar.learn(df)
    assert model.automata == () and [r["spans"] for r in grammar.scan(df, model).collect()] == [[], []]
    none = grammar.scan(df.limit(0), grammar.learn(df.limit(0)))
    assert none.collect() == [] and none.columns == ["doc_id", "text", "spans"]


def test_query_digests(spark):
    sf = "/root/testdata/sf0.001"
    got = {r["doc_id"]: r for r in op11_grammar_secrets(spark, sf).collect()}
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert got.keys() == texts.keys()
    for i, t in texts.items():
        base = plain_base(t or "")
        shown = [f"{k}:{s}:{e}" for k, s, e in base]
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(shown).encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k in grammar.KINDS[:3]] == [sum(b[0] == k for b in base) for k in grammar.KINDS[:3]]
        assert [x for x in got[i]["spans"].split(",") if x and not x.startswith("format")] == shown
