"""Splitting text into chunks that byte-level BPE encodes independently of each other, and remembering their ids.

The split pattern of byte-level BPE starts a new match before a single space that follows a
non-space: whatever precedes it can't take that space, and what follows takes it as its first
character. So a text without runs of white space around a space is the concatenation of its first
word and of " " + word for the others. Texts that have such runs are encoded as a whole.
"""

from __future__ import annotations

import secrets
from collections.abc import Callable, Iterable
from typing import Generic, TypeVar

import numpy as np

from supplymesh.llm.bytehash import run_hashes

K, V = TypeVar("K"), TypeVar("V")
#: Entries of a memory's generation; chunks of more characters aren't remembered.
GENERATION, CHARS = 400_000, 64
#: Bytes of text whose chunks are looked up in one go, about.
GROUP = 1 << 20


class Generations(Generic[K, V]):
    """A memory of two generations: when the younger is full it becomes the older, and what the older held and nobody asked for since goes."""

    def __init__(self, entries: int = GENERATION):
        self.entries, self.young, self.old = entries, {}, {}

    def recall(self, keys: Iterable[K]) -> set[K]:
        """Moves to the younger generation what is known of the keys, and returns the others. All fit into it together."""
        keys = keys if isinstance(keys, set) else set(keys)
        unknown = keys.difference(self.young)
        if len(self.young) + len(unknown) > self.entries:
            self.young, self.old, unknown = {}, self.young, keys
        old, young = self.old, self.young
        missing = set()
        for k in unknown:
            v = old.get(k)
            if v is None:
                missing.add(k)
            else:
                young[k] = v
        return missing


class IdTable:
    """Ids of chunks by their hash, in arrays: sorted hashes, and where each one's ids lie."""

    def __init__(self):
        self.keys, self.start, self.count = np.zeros(0, "u8"), np.zeros(0, "i8"), np.zeros(0, "i8")
        self.ids, self.used = np.zeros(1 << 16, "<u4"), 0

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For sorted keys, their places in the table, and whether they are there."""
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        return at, (self.keys[at] == keys) if len(self.keys) else np.zeros(len(keys), "?")

    def add(self, keys: np.ndarray, ids: np.ndarray, count: np.ndarray) -> None:
        """New keys, sorted, with their ids one after the other."""
        if self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.used], np.zeros(len(ids) + self.used, "<u4")])
        self.ids[self.used : self.used + len(ids)] = ids
        at = np.searchsorted(self.keys, keys)
        self.keys, self.count = np.insert(self.keys, at, keys), np.insert(self.count, at, count)
        self.start = np.insert(self.start, at, self.used + np.cumsum(count) - count)
        self.used += len(ids)


def gathered(ids: np.ndarray, start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """ids[start:start + count] of each, one after the other."""
    ends = np.cumsum(count)
    total = int(ends[-1]) if len(ends) else 0
    return ids[np.arange(total) + np.repeat(start - ends + count, count)]


class ChunkMemory:
    """Encodes texts by ``encode_many(strings) -> list of bytes``, asking for each distinct chunk once while it is remembered.

    The bytes of a text are the concatenation of those of its chunks: little-endian unsigned 32-bit ids. Chunks
    are told apart by 64-bit hashes of their bytes under a seed that each memory draws, all at once; what isn't separable or too long is remembered as having no ids.
    """

    def __init__(self, encode_many: Callable[[list[str]], list[bytes]], entries: int = GENERATION):
        self.encode_many, self.entries, self.seed = encode_many, entries, secrets.randbits(64)
        self.young, self.old = IdTable(), IdTable()

    @staticmethod
    def separable(word: str) -> bool:
        """False if what follows this word in the text may decide how its end is split."""
        return bool(word) and not word[-1].isspace()

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        group: list[bytes] = []
        size = start = 0
        for i, t in enumerate(texts):
            group.append(t.encode("utf-8", "surrogatepass"))
            size += len(group[-1]) + 1
            if size >= GROUP or i == len(texts) - 1:
                out += self._group(texts[start : i + 1], group)
                group, size, start = [], 0, i + 1
        return out

    def _learn(self, keys: np.ndarray, example: np.ndarray, word: Callable[[int], str]) -> None:
        """Puts all keys (sorted) into the younger table: from the older one, or by encoding their examples."""
        if len(self.young.keys) > self.entries:
            self.young, self.old = IdTable(), self.young
        new = ~self.young.find(keys)[1]
        keys, example = keys[new], example[new]
        at, there = self.old.find(keys)
        count = np.zeros(len(keys), "i8")
        count[there] = self.old.count[at[there]]
        words = [word(i) for i in example[~there].tolist()]
        good = [i for i, w in enumerate(words) if len(w) <= CHARS and self.separable(w)]
        found: list[bytes] = [b""] * len(words)
        for i, x in zip(good, self.encode_many([" " + words[i] for i in good])):
            found[i] = x
        count[~there] = np.fromiter(map(len, found), "i8", len(found)) >> 2
        fresh = np.frombuffer(b"".join(found), "<u4")
        both = np.concatenate([self.old.ids[: self.old.used], fresh])
        start = np.empty(len(keys), "i8")
        start[there] = self.old.start[at[there]]
        start[~there] = self.old.used + np.cumsum(count[~there]) - count[~there]
        self.young.add(keys, gathered(both, start, count), count)

    def _group(self, texts: list[str], raws: list[bytes]) -> list[bytes]:
        whole = b" ".join(raws) + b" "
        data = np.frombuffer(whole, "u1")
        ends = np.flatnonzero(data == 32)
        begins = np.concatenate([np.zeros(1, ends.dtype), ends[:-1] + 1])
        stops = np.cumsum([len(r) + 1 for r in raws])
        firsts = np.searchsorted(begins, np.concatenate([np.zeros(1, stops.dtype), stops[:-1]]))  # each text's first chunk

        def word(i: int) -> str:
            return whole[begins[i] : ends[i]].decode("utf-8", "surrogatepass")

        keys, example, inverse = np.unique(run_hashes(whole, begins, ends, self.seed), return_index=True, return_inverse=True)
        self._learn(keys, example, word)
        at, _ = self.young.find(keys)
        at = at[inverse]
        start, count = self.young.start[at], self.young.count[at]
        odd = count == 0  # every separable chunk has ids
        odd[firsts] = False
        count[firsts] = 0
        raw = gathered(self.young.ids, start, count).tobytes()
        edges = 4 * np.append((np.cumsum(count) - count)[firsts], count.sum())
        unusual = np.add.reduceat(odd, firsts, dtype="i8") > 0
        chunks = np.diff(np.append(firsts, len(begins)))
        first_words = [word(i) for i in firsts.tolist()]
        out = []
        for text, first, head, a, b, strange, n in zip(texts, first_words, self.encode_many(first_words), edges[:-1].tolist(), edges[1:].tolist(), unusual.tolist(), chunks.tolist()):
            if n > 1 and (strange or not self.separable(first)):
                out.append(self._unusual(text))
            else:
                out.append(head + raw[a:b])
        return out

    def _unusual(self, text: str) -> bytes:
        """A text with a chunk that isn't separable, as a whole, or with one too long to remember, chunk by chunk."""
        words = text.split(" ")
        if not all(map(self.separable, words)):
            return self.encode_many([text])[0]
        return b"".join(self.encode_many([words[0], *(" " + w for w in words[1:])]))
