"""Plain versions of the operators, for small tables."""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np


def lower_words(text: str | None) -> list[bytes]:
    return bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode()).split()


def shingle_set(text: str | None, width: int) -> frozenset:
    w = lower_words(text)
    if len(w) < width:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1))


def components(n: int, links) -> list[int]:
    up = list(range(n))

    def root(x: int) -> int:
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def near_copies(texts: list[str | None], width: int = 4, percent: int = 80) -> list[tuple[int, int]]:
    """(set size, component) of each text, numbered by place."""
    sets = [shingle_set(t, width) for t in texts]
    links = [
        (i, j)
        for i, a in enumerate(sets)
        for j, b in enumerate(sets[:i])
        if a and b and 100 * len(a & b) >= percent * len(a | b)
    ]
    return list(zip(map(len, sets), components(len(texts), links)))


def cut_repeats(texts: list[str | None], length: int) -> list[tuple[int, int, int, str]]:
    """(bytes, removed, spans, sha256 of the rest) of each text."""
    raw = [(t or "").encode() for t in texts]
    seen = Counter(t[i : i + length] for t in raw for i in range(len(t) - length + 1))
    out = []
    for t in raw:
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        rest = bytes(b for b, g in zip(t, gone) if not g)
        spans = int((gone[:-1] & ~np.concatenate([[False], gone[:-2]])).sum()) if t else 0
        out.append((len(t), int(gone[:-1].sum()), spans, hashlib.sha256(rest).hexdigest()))
    return out
