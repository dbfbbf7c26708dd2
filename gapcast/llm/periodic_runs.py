"""Runs of repeated words: maximal stretches that go round with a period.

A run is a stretch of consecutive words with smallest period q and length of at least
``max(6, 4 q)`` that no neighbouring word extends with period q. Words are the stretches of
bytes other than 0x20 and 0x09-0x0D, as they stand, compared by hashes of 64 bits.

Squares are found with a suffix automaton whose link tree is accessed as a link-cut tree:

1. ``automaton`` reads the words and yields its states, the tree of suffix links and the
   state of every prefix.
2. ``squares`` goes through the prefixes. The tree is cut into preferred paths; all states
   of a path were last seen at one word, the path's colour. An access from a prefix's state
   to the root meets the paths that its suffixes lie on. A suffix on a path of colour e whose
   longest states there have L words ended at word e before, so if the distance d = i - e is
   at most L, a square of period d ends at word i. The access then cuts what lies deeper from
   those paths and makes the way to the root one path of colour i. A path is kept as an array
   ordered by length, so the place of a cut is found by bisection and a path grows at its end.
3. Squares are extended to both sides to runs. In a run of period q and length of at least
   2 q, the latest earlier end of the q words before any place past 2 q is q words back (a
   nearer one would make them a power and q not the smallest), so no run is missed, and the
   distances met are smallest periods.

Most texts have no run. ``regions`` leaves out, exactly, what can't be in one: a run of
period q has at least 3 q - 2 neighbouring places whose three words stood at most q places
before, too. Places further from their earlier like than the stretch around them allows are
dropped until none is. Automata are built over the rest, with borders.

Each row is worked on by itself and whole; memory is that of one text, its words and, where
it repeats, its automaton. Rows are only read, so copies and hot sources need no exchange.
Repeated doc_ids are rows of their own. A null text has no words; a row without doc_id has no
rounds planted by ``planted``. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapcast.llm.textbytes import _SPACE, U64, buffer_of, mix, prefix_hash, slices, span_hash

LEAST = 6  # words of a run
ROUNDS = 4  # periods of a run
Run = tuple[int, int, int]  # start, length, period

SCHEMA = (
    "doc_id bigint, n_words bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, "
    "runs_sha256 string, collapsed_sha256 string"
)


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words as they stand, and for each row the number of words before it."""
    solid = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before, after = np.ones(len(data), bool), np.ones(len(data), bool)
    before[1:], after[:-1] = ~solid[:-1], ~solid[1:]
    starts = np.flatnonzero(solid & (before | edge[:-1]))
    ends = np.flatnonzero(solid & (after | edge[1:])) + 1
    hashes = span_hash(prefix_hash(data), starts, ends) if len(starts) else np.zeros(0, U64)
    return hashes, np.searchsorted(starts, offsets)


def planted(doc_id: int | None, n: int) -> np.ndarray | None:
    """For each word the original word that takes its place, where the id asks for rounds."""
    if doc_id is None or not n:
        return None
    h = zlib.crc32(str(doc_id).encode())
    g, rest = divmod(h, 10)
    if rest:
        return None
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    at[a:] = a + np.arange(n - a) % p
    return at


def regions(words: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(row, start, end): stretches of a row's words that hold all of its runs with a word on either side.

    ``first`` has for each row the number of words before it, as ``words_of`` returns.
    """
    n = len(words) - 2
    if n < 1:
        return
    three = mix(words[:n] + mix(words[1 : n + 1] + mix(words[2:], 1), 2), 3)
    order = np.argsort(three, kind="stable")
    same = three[order[1:]] == three[order[:-1]]
    back = np.full(n, n + 3, np.int64)
    back[order[1:][same]] = np.diff(order)[same]
    # Neither the three words nor their likes may reach into another row.
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    at = np.flatnonzero(back <= n)
    at = at[(row[at] == row[at + 2]) & (row[at] == row[at - back[at]])]
    while len(at):
        cut = np.flatnonzero((np.diff(at) > 1) | (row[at[1:]] != row[at[:-1]])) + 1
        length = np.diff(np.concatenate([[0], cut, [len(at)]]))
        alive = back[at] <= np.repeat((length + 2) // 3, length)
        if alive.all():
            break
        at = at[alive]
    if not len(at):
        return
    cut = np.flatnonzero((np.diff(at) > 1) | (row[at[1:]] != row[at[:-1]])) + 1
    for low, high in zip([0, *cut], [*cut, len(at)]):
        x, y = int(at[low]), int(at[high - 1]) + 1
        widest = (y - x + 2) // 3
        r = int(row[x])
        yield r, max(int(first[r]), x - widest - 1), min(int(first[r + 1]), y + 3)


def automaton(words: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Length and suffix link of every state, and the state of every prefix."""
    length, link, ahead, prefix = [0], [-1], [{}], []
    last = 0
    for n, word in enumerate(words, 1):
        new = len(length)
        length.append(n)
        link.append(0)
        ahead.append({})
        p = last
        while p >= 0 and word not in ahead[p]:
            ahead[p][word] = new
            p = link[p]
        if p >= 0:
            q = ahead[p][word]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                twin = len(length)
                length.append(length[p] + 1)
                link.append(link[q])
                ahead.append(ahead[q].copy())
                while p >= 0 and ahead[p].get(word) == q:
                    ahead[p][word] = twin
                    p = link[p]
                link[q] = link[new] = twin
        prefix.append(new)
        last = new
    return length, link, prefix


def squares(words: list[int]) -> Iterator[tuple[int, int]]:
    """(i, d): a square of period d ends at word i; the shortest way back to each repeated end.

    ``nodes[p]`` is a preferred path from its top down, ``lengths[p]`` the lengths of its states.
    """
    length, link, prefix = automaton(words)
    path = [-1] * len(length)  # of each state; -1 before its first access
    nodes: list[list[int]] = []
    lengths: list[list[int]] = []
    colour: list[int] = []
    for i, state in enumerate(prefix):
        met = []  # (path, how many of its states lie on the way), from below
        fresh = []  # states not accessed before, from below
        v = state
        while v > 0:
            p = path[v]
            if p < 0:
                fresh.append(v)
                v = link[v]
                continue
            on_way = bisect_right(lengths[p], length[v])
            d = i - colour[p]
            if d <= length[v]:
                yield i, d
            met.append((p, on_way))
            v = link[nodes[p][0]]
        # The topmost path is kept and grows; what lay deeper on each path becomes a path of the old colour.
        for p, on_way in met:
            if on_way < len(nodes[p]):
                rest = len(nodes)
                nodes.append(nodes[p][on_way:])
                lengths.append(lengths[p][on_way:])
                colour.append(colour[p])
                for u in nodes[rest]:
                    path[u] = rest
                del nodes[p][on_way:], lengths[p][on_way:]
        if met:
            top = met[-1][0]
        else:
            top = len(nodes)
            nodes.append([])
            lengths.append([])
            colour.append(i)
        for p, _ in reversed(met[:-1]):
            for u in nodes[p]:
                path[u] = top
            nodes[top] += nodes[p]
            lengths[top] += lengths[p]
            nodes[p], lengths[p] = [], []
        for u in reversed(fresh):
            path[u] = top
            nodes[top].append(u)
            lengths[top].append(length[u])
        colour[top] = i


def _reach(words: np.ndarray, x: int, y: int, step: int) -> int:
    """How many words match from x and y on, going by ``step``."""
    width, done = 32, 0
    while True:
        if step > 0:
            a, b = words[x + done : x + done + width], words[y + done : y + done + width]
            a = a[: len(b)]
        else:
            low = max(0, x - done + 1 - width)
            a = words[low : x - done + 1][::-1]
            b = words[y - done + 1 - len(a) : y - done + 1][::-1]
        if not len(a):
            return done
        other = np.flatnonzero(a != b)
        if len(other):
            return done + int(other[0])
        done += len(a)
        width *= 2


def runs_in(words: np.ndarray, low: int, high: int) -> set[Run]:
    """Runs that touch [low, high) of a row's words, found there and extended over all of the row."""
    _, ids = np.unique(words[low:high], return_inverse=True)
    until: dict[int, int] = {}  # end of the latest stretch of each period
    found = set()
    for i, d in squares(ids.tolist()):
        end = low + i
        if until.get(d, -1) > end:
            continue
        start = end + 1 - d - _reach(words, end - d, end, -1)
        stop = end + 1 + _reach(words, end + 1 - d, end + 1, 1)
        until[d] = stop
        if stop - start >= max(LEAST, ROUNDS * d):
            found.add((start, stop - start, d))
    return found


def strongest(runs: list[Run]) -> Run | None:
    """The run of the greatest exact length / period; ties to the smallest start, then period."""
    best = None
    for run in runs:
        if best is None or (run[1] * best[2], -run[0], -run[2]) > (best[1] * run[2], -best[0], -best[2]):
            best = run
    return best


def kept_words(n: int, runs: list[Run]) -> np.ndarray:
    """Which words stay when of each run only the first period is kept."""
    kept = np.ones(n, bool)
    for start, length, period in runs:
        kept[start + period : start + length] = False
    return kept


Edit = Callable[[int | None, int], np.ndarray | None]


def _rows(data: np.ndarray, offsets: np.ndarray, ids: list[int | None], edit: Edit | None) -> Iterator[tuple[np.ndarray | None, list[Run], int]]:
    """For each row of a slice: the places of its words after editing, its runs, its number of words."""
    words, first = words_of(data, offsets)
    places = [edit(ids[r], int(first[r + 1] - first[r])) if edit else None for r in range(len(ids))]
    for r, at in enumerate(places):
        if at is not None:
            words[first[r] : first[r + 1]] = words[first[r] : first[r + 1]][at]
    found: dict[int, set[Run]] = {}
    for r, low, high in regions(words, first):
        lead = int(first[r])
        found.setdefault(r, set()).update(runs_in(words[lead : int(first[r + 1])], low - lead, high - lead))
    for r, at in enumerate(places):
        yield at, sorted(found.get(r, ()), key=lambda x: (x[0], x[2])), int(first[r + 1] - first[r])


def _each(documents: DataFrame, edit: Edit | None, put, schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffer_of(batch.column(1))
            ids = batch.column(0).to_pylist()
            out = []
            for i, j in slices(offsets):
                part, own = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                for k, (at, runs, n) in enumerate(_rows(part, own, ids[i:j], edit)):
                    text = part[own[k] : own[k + 1]].tobytes().split()
                    out += put(ids[i + k], text if at is None else [text[x] for x in at.tolist()], runs, n)
            yield pa.RecordBatch.from_pylist(out, schema=kinds)

    names = [f.split() for f in schema.split(", ")]
    kinds = pa.schema([(n, pa.int64() if t == "bigint" else pa.string()) for n, t in names])
    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, schema)


def find_runs(documents: DataFrame, edit: Edit | None = None) -> DataFrame:
    """doc_id, start, length, period: a row for every run, places counted in words.

    ``edit`` gives from doc_id and number of words the places of the words to read instead, or None.
    """

    def put(doc_id, text, runs, n):
        return [{"doc_id": doc_id, "start": s, "length": m, "period": q} for s, m, q in runs]

    return _each(documents, edit, put, "doc_id bigint, start bigint, length bigint, period bigint")


def collapse(documents: DataFrame, edit: Edit | None = None) -> DataFrame:
    """doc_id, text: words joined by one space, of each run only the first period."""

    def put(doc_id, text, runs, n):
        if runs:
            text = [w for w, k in zip(text, kept_words(n, runs).tolist()) if k]
        return [{"doc_id": doc_id, "text": b" ".join(text).decode()}]

    return _each(documents, edit, put, "doc_id bigint, text string")


def summary(documents: DataFrame, edit: Edit | None = planted) -> DataFrame:
    """One row per document: its number of runs, the strongest run, digests of all runs and of the collapsed text."""

    def put(doc_id, text, runs, n):
        best = strongest(runs)
        start, length, period = best or (None, None, None)
        listed = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
        if runs:
            text = [w for w, k in zip(text, kept_words(n, runs).tolist()) if k]
        return [
            {
                "doc_id": doc_id, "n_words": n, "n_runs": len(runs), "start": start, "length": length, "period": period,
                "exponent_milli": 1000 * length // period if best else None,
                "runs_sha256": hashlib.sha256(listed.encode()).hexdigest(),
                "collapsed_sha256": hashlib.sha256(b" ".join(text)).hexdigest(),
            }
        ]

    return _each(documents, edit, put, SCHEMA)
