"""Runs of repeated words against a search of every stretch."""

from __future__ import annotations

import hashlib
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from gapcast.llm import periodic_runs


def words_of(text: str | None, doc_id: int | None) -> list[str]:
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    if doc_id is None or not n or zlib.crc32(str(doc_id).encode()) % 10:
        return words
    g = zlib.crc32(str(doc_id).encode()) // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def smallest_period(words: list[str]) -> int:
    return next(q for q in range(1, len(words) + 1) if all(words[i] == words[i - q] for i in range(q, len(words))))


def all_runs(words: list[str]) -> list[tuple[int, int, int]]:
    found, n = set(), len(words)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q) and smallest_period(words[i : j + q]) == q:
                found.add((i, j + q - i, q))
            i = max(j, i) + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def plain(doc_id, text) -> tuple:
    words = words_of(text, doc_id)
    runs = all_runs(words)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else None
    kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + m for s, m, q in runs)]
    listed = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    tail = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(words), len(runs), *tail, sha(listed), sha(" ".join(kept)))


def summaries(spark, rows):
    table = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id bigint, text string, n_runs string")
    got = sorted(map(tuple, periodic_runs.summary(table).collect()), key=str)
    assert got == sorted((plain(i, t) for i, t in rows), key=str)
    return got


def random_words(rng, n: int, letters: int) -> list[str]:
    """Words of a small alphabet with stretches that go round."""
    out: list[str] = []
    while len(out) < n:
        if rng.random() < 0.4:
            out += [str(x) for x in rng.integers(0, letters, rng.integers(1, 9))]
        else:
            root = [str(x) for x in rng.integers(0, letters, rng.integers(1, 7))]
            out += (root * 9)[: len(root) * int(rng.integers(1, 7)) + int(rng.integers(0, len(root)))]
    return out[:n]


def test_automaton_finds_every_square_end():
    rng = np.random.default_rng(3)
    for _ in range(150):
        words = rng.integers(0, 3, rng.integers(1, 40)).tolist()
        primitive = set()
        for i in range(len(words)):
            for d in range(1, (i + 1) // 2 + 1):
                half = words[i - d + 1 : i + 1]
                if half == words[i - 2 * d + 1 : i - d + 1] and not any(
                    d % k == 0 and half == half[:k] * (d // k) for k in range(1, d)
                ):
                    primitive.add((i, d))
        assert set(periodic_runs.squares(words)) == primitive


@pytest.mark.parametrize("letters", [1, 2, 3, 9, 40])
def test_runs_of_random_words(letters):
    rng = np.random.default_rng(letters)
    for _ in range(60):
        words = np.array(random_words(rng, int(rng.integers(0, 120)), letters), dtype="U4")
        ids = periodic_runs.mix(np.unique(words, return_inverse=True)[1].astype(np.uint64)) if len(words) else np.zeros(0, np.uint64)
        found = set()
        for _, low, high in periodic_runs.regions(ids, np.array([0, len(ids)])):
            found |= periodic_runs.runs_in(ids, low, high)
        assert sorted(found, key=lambda r: (r[0], r[2])) == all_runs(words.tolist())


def test_summary_against_brute_force(spark):
    rng = np.random.default_rng(11)
    rows = [(int(i), " ".join(random_words(rng, int(rng.integers(1, 90)), int(rng.integers(2, 12))))) for i in range(150)]
    got = summaries(spark, rows)
    assert sum(r[2] > 0 for r in got) > 40
    planted = [i for i, t in rows if periodic_runs.planted(i, len(t.split())) is not None]
    assert len(planted) > 5


def test_odd_rows(spark):
    no_break = "a a a a a a a a a a a a"
    rows = [
        (1, None), (2, ""), (3, " \t\r\n\x0b\x0c "), (4, "x"), (None, "a b " * 5), (None, None), (6, "a " * 5), (7, "a " * 6),
        (8, "a b " * 4), (8, "a b " * 4), (8, "A a " * 4), (9, "a b c " * 3 + "a b"), (10, no_break), (11, "é ü " * 30),
        (12, "w " * 20_000), (13, "a b c d e f g " * 3_000 + "z"), (-5, "q\x00q " * 9), (2**62, " a " * 7),
    ]
    table = spark.createDataFrame([(i, t) for i, t in rows], "doc_id bigint, text string")
    got = sorted(map(tuple, periodic_runs.summary(table).collect()), key=str)
    small = [r for r in rows if len(r[1] or "") < 5_000]
    want = [plain(i, t) for i, t in small]
    assert sorted([g for g in got if g[0] not in (12, 13)], key=str) == sorted(want, key=str)
    by_id = {g[0]: g for g in got}
    assert periodic_runs.planted(12, 9) is None and by_id[12][2:7] == (1, 0, 20_000, 1, 20_000_000)
    assert periodic_runs.planted(13, 9) is None and by_id[13][2:7] == (1, 0, 21_000, 7, 3_000_000)


def test_empty_table_and_real_outputs(spark):
    schema = "doc_id bigint, text string"
    assert periodic_runs.summary(spark.createDataFrame([], schema)).collect() == []
    table = spark.createDataFrame([(1, "x a b a b a b a b y z z z z z z")], schema)
    got = sorted(map(tuple, periodic_runs.find_runs(table).collect()))
    assert got == [(1, 1, 8, 2), (1, 10, 6, 1)]
    assert periodic_runs.collapse(table).first().text == "x a b y z"


def test_rows_next_to_each_other_do_not_meet(spark):
    rows = [(k, "a b a b") for k in range(40)] + [(100 + k, "b a b a b") for k in range(3)]
    assert all(r[2] == 0 for r in summaries(spark, [r for r in rows if zlib.crc32(str(r[0]).encode()) % 10]))
