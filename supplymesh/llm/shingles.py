"""Sets of word shingles as 64-bit hashes, computed for many texts at once in arrays.

Words are runs of bytes other than white space (space and tab to carriage return), A-Z lower-cased.
A shingle's hash mixes those of its words in order. Two of n different shingles have equal hashes with a
chance of about n^2 / 2^65; all hashes depend on a seed, which a run draws for itself.
"""

from __future__ import annotations

import numpy as np

from supplymesh.llm.bytehash import U, mix, run_hashes

#: Words in a shingle.
WORDS = 5
#: Bytes of text hashed in one go, about.
GROUP = 1 << 19
_PLACE = np.random.default_rng(5).integers(1, 1 << 63, WORDS, dtype="u8") * U(2) + U(1)
_SPACE = np.zeros(256, "?")
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def _group_sets(datas: list[bytes], seed: int) -> list[np.ndarray]:
    whole = b" ".join(datas).translate(_LOWER) + b" "
    b = np.frombuffer(whole, "u1")
    space = _SPACE[b]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    first = not space[0]
    begins = edge[1::2] if first else edge[0::2]
    ends = edge[0::2] if first else edge[1::2]
    if first:
        begins = np.concatenate([np.zeros(1, begins.dtype), begins])
    begins = begins[: len(ends)]
    word = run_hashes(whole, begins, ends, seed)
    stops = np.cumsum([len(d) + 1 for d in datas])
    last = np.searchsorted(begins, stops, "left")  # words up to each text's end
    n = len(word)
    if n >= WORDS:
        shingle = np.zeros(n - WORDS + 1, "u8")
        for k in range(WORDS):
            shingle += word[k : n - WORDS + 1 + k] * _PLACE[k]
        shingle = mix(shingle)
    out, at = [], 0
    for end in last.tolist():
        count = end - at
        if count >= WORDS:
            own = np.sort(shingle[at : end - WORDS + 1])
            keep = np.empty(len(own), "?")
            keep[0] = True
            np.not_equal(own[1:], own[:-1], out=keep[1:])
            out.append(own[keep])
        elif count:
            out.append(mix((word[at:end] * _PLACE[:count]).sum(keepdims=True) + U(count)))
        else:
            out.append(np.zeros(0, "u8"))
        at = end
    return out


def shingle_sets(texts: list[str | None], seed: int = 0) -> list[np.ndarray]:
    """Each text's set of shingle hashes, sorted. Fewer words than a shingle's are one shingle; no words, or null: the empty set."""
    out: list[np.ndarray] = []
    group: list[bytes] = []
    size = 0
    for t in texts:
        group.append((t or "").encode("utf-8", "surrogatepass"))
        size += len(group[-1])
        if size >= GROUP:
            out += _group_sets(group, seed)
            group, size = [], 0
    return out + (_group_sets(group, seed) if group else [])
