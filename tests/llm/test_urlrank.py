"""URL filters against a brute-force version."""

import random

import pytest

from supplymesh.llm import urlrank

PAGES = "page_id long, url string, html string, host string"


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
    host, tail = rest[:end], rest[end:]
    stop = next((i for i, c in enumerate(tail) if c in "?#"), len(tail))
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), tail[:stop]


def rule_of(host, path):
    fits = [(len(r), r, v) for v, r in urlrank.RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[len(r.split("/")[0]) :])]
    return max(fits)[1:] if fits else (None, None)


def ranks(seed, edges):
    """Personalised PageRank by power iteration: seeds add up to one, and hosts without links give all they hold back to the seeds."""
    total, out = sum(seed.values()), {}
    for a, _ in edges:
        out[a] = out.get(a, 0) + 1
    score = {h: x / total for h, x in seed.items()}
    for _ in range(300):
        lost = sum(x for h, x in score.items() if h not in out)
        new = {h: (1 - urlrank.DAMPING + urlrank.DAMPING * lost) * x / total for h, x in seed.items()}
        for a, b in edges:
            if a in score:
                new[b] = new.get(b, 0) + urlrank.DAMPING * score[a] / out[a]
        score = new
    return score


def test_rules_and_verdicts(spark):
    r = random.Random(4)
    hosts = ["a.example.com", "b.example.com", "c.example.net", "d.org", "e.org", "net", "X.Example.COM", "notexample.com", "f.fr"]
    rows = []
    for i in range(160):
        links = "".join(f'<a href="{r.choice(["https://", "//", "/", "http://"])}{r.choice(hosts)}/x">' for _ in range(r.randint(0, 3)))
        rows.append((i, f"https://{r.choice(hosts)}/{r.choice(['en/7', 'en/1', 'de/8', 'de/1', 'es/2', 'fr/3', ''])}{r.choice(['', '?q=/en/', '#z'])}", links, "clash"))
    rows += [(500, None, None, None), (501, "no scheme", "", None), (502, "http://", "x", None), (502, "http://", "x", None), (None, "ftp://d.org/es/?://", "", None), (503, "a://b://c/en/", "", None)]
    got = urlrank.judge(spark.createDataFrame(rows, PAGES)).collect()
    assert len(got) == len(rows)
    edges, seeds = set(), ({}, {})
    for _, url, html, _ in rows:
        h, p = split(url)
        _, v = rule_of(h, p)
        if h and v:
            side = seeds[v == "block"]
            side[h] = side.get(h, 0) + 1
        for piece in (html or "").split('href="')[1:]:
            t = piece.split('"')[0]
            t = t.split("//", 1)[1] if "//" in t else ""
            t = split("x://" + t)[0] if t else ""
            if h and t and t != h:
                edges.add((h, t))
    trust, distrust = ranks(seeds[0], edges), ranks(seeds[1], {(b, a) for a, b in edges})
    for g in got:
        url = next(u for i, u, _, _ in rows if i == g.page_id and split(u) == (g.host, g.path))
        rule, verdict = rule_of(*split(url))
        t, d = trust.get(g.host, 0), distrust.get(g.host, 0)
        assert g.rule == rule
        if verdict or abs(d - t) > 0.02 * (d + t):
            assert g.verdict == (verdict or ("block" if g.host and d > t else "allow")), g


def test_propagation_with_hubs(spark):
    r = random.Random(1)
    edges = {(f"h{r.randrange(40)}", f"h{r.choice([0, 0, r.randrange(40)])}") for _ in range(200)}
    edges = {e for e in edges if e[0] != e[1]}
    seeds = [("h1", 3, 0), ("h2", 1, 2), ("h0", 0, 1)]
    got = {x.host: (x.trust, x.distrust) for x in urlrank.propagate(spark.createDataFrame(seeds, "host string, trust long, distrust long"), spark.createDataFrame(list(edges), "source string, target string")).collect()}
    t = ranks({h: n for h, n, _ in seeds if n}, edges)
    d = ranks({h: n for h, _, n in seeds if n}, {(b, a) for a, b in edges})
    for h in set(t) | set(d):
        assert got.get(h, (0, 0)) == pytest.approx((t.get(h, 0), d.get(h, 0)), abs=1e-5)
    assert sum(x for x, _ in got.values()) == pytest.approx(1) == sum(x for _, x in got.values())


def test_what_dangling_hosts_hold_goes_back(spark):
    """Trust dangles at C's end of nowhere, distrust at A: left out, X would have less distrust than trust."""
    edges = [("A", "X"), ("X", "B"), ("B", "C"), ("C", "B")]
    found = urlrank.propagate(spark.createDataFrame([("A", 1, 0), ("B", 0, 1)], "host string, trust long, distrust long"), spark.createDataFrame(edges, "source string, target string"))
    got = {x.host: x.distrust / (x.trust + x.distrust) for x in found.collect()}
    t, d = ranks({"A": 1}, edges), ranks({"B": 1}, [(b, a) for a, b in edges])
    assert got["X"] == pytest.approx(d["X"] / (d["X"] + t["X"]), abs=1e-4) and got["X"] > 0.5
    pages = [(1, "http://A/x", '<a href="http://X/">', ""), (2, "http://X/x", '<a href="http://B/">', ""), (3, "http://B/x", '<a href="http://C/">', ""), (4, "http://C/x", '<a href="http://B/">', "")]
    rules = (("allow", "a/"), ("block", "b/"))
    judged = {x.host: x.verdict for x in urlrank.judge(spark.createDataFrame(pages, PAGES), rules).collect()}
    assert judged == {"a": "allow", "x": "block", "b": "block", "c": "block" if d["C"] > t["C"] else "allow"}


def test_long_chain(spark):
    edges = [(f"h{i}", f"h{i + 1}") for i in range(50)]
    found = urlrank.propagate(spark.createDataFrame([("h0", 1, 0), ("h50", 0, 1)], "host string, trust long, distrust long"), spark.createDataFrame(edges, "source string, target string"))
    got = {x.host: (x.trust, x.distrust) for x in found.collect()}
    whole = sum(0.85**i for i in range(51))
    for i in range(51):
        assert got[f"h{i}"] == pytest.approx((0.85**i / whole, 0.85 ** (50 - i) / whole), abs=1e-4) and min(got[f"h{i}"]) > 0
    with pytest.raises(RuntimeError):
        urlrank.propagate(spark.createDataFrame([("h0", 1, 0)], "host string, trust long, distrust long"), spark.createDataFrame(edges, "source string, target string"), rounds=3)


def test_empty(spark):
    assert urlrank.judge(spark.createDataFrame([], PAGES)).count() == 0
