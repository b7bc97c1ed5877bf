"""Secret scans: credentials by patterns, and more of them by inferred grammars.

Patterns find the base spans. The credentials in them, distinct and by kind, are the labelled samples of a grammar each: their prefix
tree is folded into a probabilistic automaton by merging states whose ends and next symbols differ by no more than Hoeffding's bound
allows, also after every common continuation (state merging in the manner of ALERGIA). A literal beginning stays a chain of states, random
symbols become a loop.

All other long runs of credential characters are candidates. A candidate's likelihood under the mixture of the automata is held against its
likelihood under a background of character pairs, counted over all candidates of all documents; from a symbol on that an automaton hasn't seen it goes on as the
background does, so that what no grammar knows earns nothing. Both are distributions over strings, so a string from the background reaches a ratio of t with a chance of 1 / t at most; a candidate becomes a span where the ratio is at least
the number of all candidates over EXPECTED, the chance findings expected in the whole corpus.

Null texts are empty and have no spans; positions count code points. Without base spans there is no grammar and no span is added. Equal
rows are judged alike, each by itself. Base spans stay whatever their likelihood is.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from supplymesh.llm.common import lean, prepare, schema_with, stored

#: The kinds of spans in their order; the last are those that grammars add.
KINDS = ("assign", "access", "hex", "format")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # whole runs, as no shorter one can begin within
ASSIGN_LEAST, ACCESS_LEAST = 6, 20
#: Candidates are whole runs of credential characters, of so many at least.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{12,}")
SYMBOLS = "+-./0123456789=ABCDEFGHIJKLMNOPQRSTUVWXYZ_abcdefghijklmnopqrstuvwxyz"
END = len(SYMBOLS)
#: A grammar learns from so many distinct credentials of its kind at most, the first by hash, of so many characters at most.
SAMPLE, SAMPLE_CHARS = 2000, 256
#: States are told apart where they would be alike with this chance at most.
CHANCE = 0.001
#: Background strings that are expected to be taken for credentials in a whole corpus.
EXPECTED = 0.01
SPANS = "array<struct<kind:string,start:int,end:int,score:double>>"

_CODE = np.full(256, END, "u1")
_CODE[np.frombuffer(SYMBOLS.encode(), "u1")] = np.arange(END)


def base_spans(text: str) -> list[tuple[int, int, int, int]]:
    """(start, kind's number, end, start of the credential) of the base patterns' matches, in order."""
    out = []
    low = text.lower()
    if any(w in low for w in WORDS):
        out += [(m.start(), 0, m.end(), m.start(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    out += [(m.start(), 2, m.end(), m.start()) for m in HEX.finditer(text)]
    return sorted(out)


def candidates(text: str, base: list[tuple[int, int, int, int]]) -> list[tuple[int, int]]:
    """(start, end) of the runs that no base span touches."""
    runs = [m.span() for m in CANDIDATE.finditer(text)]
    if not base or not runs:
        return runs
    out, i, reach = [], 0, -1
    for start, end in runs:
        while i < len(base) and base[i][0] < end:
            reach = max(reach, base[i][2])
            i += 1
        # spans that begin before this run's end have all been seen; one of them touches it if it reaches beyond its start
        if reach <= start:
            out.append((start, end))
    return out


def codes(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of all strings in a row, and their lengths."""
    return _CODE[np.frombuffer("".join(strings).encode(), "u1")], np.array([len(s) for s in strings], "i8")


# --- automata ------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Automaton:
    """Next state (0: the sink) and log-probability of each symbol, END included, in each state; a string begins in state 1."""

    move: np.ndarray
    log: np.ndarray

    def steps(self, strings: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Strings, their states and their symbols, END last, one place after the other; longest strings first, so that long ones cost no memory."""
        flat, length = codes(strings)
        begin = np.concatenate([[0], np.cumsum(length)[:-1]]).astype("i8")
        order = np.argsort(-length, kind="stable")
        begin, sizes = begin[order], length[order]
        state = np.ones(len(order), "i4")
        ends = np.searchsorted(-sizes, -np.arange(int(sizes.max(initial=0)) + 1), "right")  # how many strings are at least so long
        for j in range(1, len(ends)):
            n = int(ends[j])
            symbol = flat[begin[:n] + j - 1]
            yield order[:n], state[:n], symbol
            state[:n] = self.move[state[:n], symbol]
        yield order, state, np.full(len(order), END)

    def logs(self, strings: list[str], background: Automaton | None = None) -> np.ndarray:
        """Log-likelihoods; with a background, their ratios to it. What follows in the sink is the background's."""
        total = np.zeros(len(strings))
        other = background.steps(strings) if background else None
        for at, state, symbol in self.steps(strings):
            gain = self.log[state, symbol]
            if other:
                gain = np.where(state == 0, 0.0, gain - background.log[next(other)[1], symbol])
            total[at] += gain
        return total


class _Tree:
    """A prefix tree with counts, whose states are merged in place."""

    def __init__(self, strings: Iterable[str]):
        self.child: list[dict[int, int]] = [{}]
        self.seen, self.ended = [0], [0]
        self.taken: list[dict[int, int]] = [{}]  # how often each symbol was taken
        for s in sorted(strings):
            at = 0
            for c in codes([s])[0].tolist():
                self.seen[at] += 1
                self.taken[at][c] = self.taken[at].get(c, 0) + 1
                at = self.child[at].setdefault(c, len(self.child))
                if at == len(self.child):
                    self.child.append({})
                    self.taken.append({})
                    self.seen.append(0)
                    self.ended.append(0)
            self.seen[at] += 1
            self.ended[at] += 1

    def alike(self, a: int, b: int, width: float) -> bool:
        """Whether two states, and those that common continuations lead to, differ by no more than Hoeffding's bound."""
        todo = [(a, b)]
        while todo:
            x, y = todo.pop()
            n, m = self.seen[x], self.seen[y]
            bound = width * (1 / math.sqrt(n) + 1 / math.sqrt(m))
            if bound < 1:
                if abs(self.ended[x] / n - self.ended[y] / m) > bound:
                    return False
                p, q = self.taken[x], self.taken[y]
                if any(abs(p.get(c, 0) / n - q.get(c, 0) / m) > bound for c in p.keys() | q.keys()):
                    return False
            todo += [(self.child[x][c], z) for c, z in self.child[y].items() if c in self.child[x]]
        return True

    def support(self, a: int, b: int) -> float:
        """The log-likelihood of the continuations of b, read from a; symbols are taken as uniform where a's continuations have ended."""
        total, todo = 0.0, [(a, b)]
        while todo:
            x, y = todo.pop()
            unseen, n = 1 / (END + 1), self.seen[x] + 1 if x >= 0 else 1
            total += self.ended[y] * math.log(((self.ended[x] if x >= 0 else 0) + unseen) / n)
            for c, z in self.child[y].items():
                total += self.taken[y][c] * math.log(((self.taken[x].get(c, 0) if x >= 0 else 0) + unseen) / n)
                todo.append((self.child[x].get(c, -1) if x >= 0 else -1, z))
        return total

    def fold(self, a: int, b: int) -> None:
        """Adds the subtree at b to the state a and what follows it."""
        todo = [(a, b)]
        while todo:
            x, y = todo.pop()
            self.seen[x] += self.seen[y]
            self.ended[x] += self.ended[y]
            for c, k in self.taken[y].items():
                self.taken[x][c] = self.taken[x].get(c, 0) + k
            for c, z in self.child[y].items():
                if c in self.child[x]:
                    todo.append((self.child[x][c], z))
                else:
                    self.child[x][c] = z


def infer(strings: Iterable[str], chance: float = CHANCE) -> Automaton:
    """The automaton of some strings. Each state next to the settled ones becomes settled too if none of them is alike, else it is merged with one: its
    parent if that is alike, which makes a loop of random symbols, else the one that makes its continuations likeliest, as rare states are alike to many."""
    tree = _Tree(strings)
    width = math.sqrt(0.5 * math.log(2 / chance))
    settled, known = [0], {0}
    while border := [(s, c) for s in settled for c in sorted(tree.child[s]) if tree.child[s][c] not in known]:
        for parent, c in border:
            new = tree.child[parent][c]
            if new in known:
                continue
            same = parent if tree.alike(parent, new, width) else max((s for s in settled if s != parent and tree.alike(s, new, width)), key=lambda s: tree.support(s, new), default=None)
            if same is None:
                settled.append(new)
                known.add(new)
            else:
                tree.child[parent][c] = same
                tree.fold(same, new)  # which may lead on from settled states by symbols that they lacked
    number = {s: i + 1 for i, s in enumerate(settled)}
    move = np.zeros((len(settled) + 1, END + 1), "i4")
    seen = np.full((len(settled) + 1, END + 1), 1 / (END + 1))  # one more string that took every symbol a bit
    for s, i in number.items():
        seen[i, END] += tree.ended[s]
        for c, k in tree.taken[s].items():
            seen[i, c] += k
            move[i, c] = number[tree.child[s][c]]
    return Automaton(move, np.log(seen / seen.sum(1, keepdims=True)))


# --- the corpus ----------------------------------------------------------------------------------


@dataclass(frozen=True)
class Grammars:
    """Automata of kinds, the background as an automaton, and the log of the likelihood ratio that a span needs."""

    automata: tuple[Automaton, ...]
    background: Automaton | None
    least: float

    def scores(self, strings: list[str]) -> np.ndarray:
        """Log-likelihood ratio of each string, credential against background."""
        if not self.automata or not strings:
            return np.full(len(strings), -np.inf)
        each = np.stack([a.logs(strings, self.background) for a in self.automata])
        top = each.max(0)
        return top + np.log(np.exp(each - top).mean(0))


def _background(pairs: dict[tuple[int, int], int]) -> Automaton:
    """Character pairs as an automaton: state 1 is the beginning, state 2 + c follows the symbol c."""
    seen = np.full((END + 2, END + 1), 1.0)
    for (a, b), n in pairs.items():
        seen[a + 2 if a < END else 1, b] += n
    move = np.tile(np.append(np.arange(END, dtype="i4") + 2, 0), (END + 2, 1)).astype("i4")
    return Automaton(move, np.log(seen / seen.sum(1, keepdims=True)))


def _evidence(docs: DataFrame, text: str) -> DataFrame:
    """(what, value, n): labelled credentials by kind; pairs of symbols in candidates, END for their beginning and end, as one number; how many candidates."""
    size = END + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, count = np.zeros(size * size, "i8"), 0
        for b in batches:
            labelled: Counter[tuple[str, str]] = Counter()
            found: list[str] = []
            for t in b.column(0).to_pylist():
                if t:
                    base = base_spans(t)
                    labelled.update((KINDS[k], t[start:end]) for _, k, end, start in base)
                    found += [t[x:y] for x, y in candidates(t, base)]
            if found:
                flat, _ = codes(["\n".join(["", *found, ""])])  # a line end has no symbol and so is END
                both = flat[:-1].astype("i4") * size + flat[1:]
                pairs += np.bincount(both, minlength=size * size)
                pairs[-1] = 0  # nothing is END twice
                count += len(found)
            keys = list(labelled)
            yield _rows([k for k, _ in keys], [v for _, v in keys], [labelled[k] for k in keys])
        some = np.flatnonzero(pairs).tolist()
        yield _rows(["pair"] * len(some) + ["candidates"], [*map(str, some), ""], [*pairs[some].tolist(), count])

    return docs.select(F.col(f"`{text}`").cast("string")).mapInArrow(lean(run), "what string, value string, n long")


def _rows(what: list[str], value: list[str], n: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(what, pa.string()), pa.array(value, pa.string()), pa.array(n, pa.int64())], names=["what", "value", "n"])


def learn(docs: DataFrame, text: str = "text", sample: int = SAMPLE, expected: float = EXPECTED) -> Grammars:
    """Grammars of the credentials that the base patterns find in all documents, and the background of all candidates. Counts are added up in
    Spark; the driver gets the pairs of symbols and ``sample`` credentials of each kind."""
    prepare(docs.sparkSession)
    found = stored(_evidence(docs, text).groupBy("what", "value").agg(F.sum("n").alias("n")), "credentials")
    pairs = {divmod(int(r["value"]), END + 1): r["n"] for r in found.filter("what = 'pair'").collect()}
    count = found.filter("what = 'candidates'").agg(F.sum("n")).first()[0] or 0
    automata = []
    for kind in KINDS[:3]:
        own = found.filter((F.col("what") == kind) & (F.length("value") <= SAMPLE_CHARS)).select("value")
        strings = [r["value"] for r in own.orderBy(F.xxhash64("value"), "value").limit(sample).collect()]
        if strings:
            automata.append(infer(strings))
    return Grammars(tuple(automata), _background(pairs), math.log(max(1, count) / expected))


def scan(docs: DataFrame, model: Grammars, text: str = "text", out: str = "spans") -> DataFrame:
    """docs with ``out``, all spans in order: kind, start, end, score (the credential's log-likelihood ratio; null without grammars). A column of
    this name is replaced, others pass through. Row by row, no shuffle."""
    prepare(docs.sparkSession)
    kept = docs.drop(out)
    row = F.struct(*(F.col(f"`{c}`") for c in kept.columns)).alias("row")
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            spans, where = [], []  # spans, and for each what is scored of it
            for i, t in enumerate(texts):
                base = base_spans(t)
                spans += [(i, start, k, end) for start, k, end, _ in base]
                where += [t[begin:end] for _, _, end, begin in base]
                if model.automata:
                    more = candidates(t, base)
                    spans += [(i, x, len(KINDS) - 1, y) for x, y in more]
                    where += [t[x:y] for x, y in more]
            score = model.scores(where).tolist()
            of: list[list[dict]] = [[] for _ in texts]
            for (i, start, k, end), s in sorted(zip(spans, score)):
                if k < len(KINDS) - 1 or s >= model.least:
                    of[i].append({"kind": KINDS[k], "start": start, "end": end, "score": s if model.automata else None})
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(of, kind)], names=["row", "found"])

    plain = kept.select(row, F.col(f"`{text}`").cast("string").alias("scanned"))
    found = plain.mapInArrow(lean(run), schema_with(plain.select("row"), ("found", SPANS)))
    return found.select("row.*", F.col("found").alias(out))
