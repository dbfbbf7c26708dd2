"""The trie of conversations against dictionaries of prefixes, and against its SQL."""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from gapcast.llm import prefix_trie

SCHEMA = "conv_id bigint, turn bigint, role string, text string, depth string"


def plain(rows, shared: bool = True) -> list[tuple]:
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts, key=lambda t: t[:2])] for c, ts in own.items()}
    full = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6 if shared else 0
        full[c] = tuple(own.get(c - int(np.fmod(c, 100)), [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, turns in full.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    kids = defaultdict(int)
    leaves, saved = defaultdict(int), defaultdict(int)
    for path in members:
        if path:
            kids[path[:-1]] += 1
    for path, convs in members.items():
        for d in range(len(path) + 1):
            leaves[path[:d]] += path not in kids
            saved[path[:d]] += (len(convs) - 1) * (len(path[-1][1]) if path else 0)
    out = []
    for path, convs in members.items():
        ends = ",".join(map(str, sorted(c for c in convs if full[c] == path)))
        up = min(members[path[:-1]]) if path else None
        out.append((min(convs), len(path), up, len(convs), kids[path], leaves[path], saved[path], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows, **options):
    table = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    return sorted(map(tuple, prefix_trie.prefix_trie(table, **options).collect()), key=str)


def random_rows(rng, ids, most: int, letters: int = 3):
    rows = []
    for c in ids:
        for turn in range(int(rng.integers(1, most + 1))):
            rows.append((int(c), turn, ["user", "bot", None][rng.integers(0, 3)], ["é" * int(rng.integers(0, letters)), None][int(rng.random() < 0.1)]))
    return [rows[i] for i in rng.permutation(len(rows))]


@pytest.mark.parametrize("width,stretch,most", [(8, 8192, 6), (3, 6, 14), (1, 2, 9)])
def test_against_brute_force(spark, width, stretch, most):
    rng = np.random.default_rng(width)
    rows = random_rows(rng, rng.choice(450, 120, replace=False), most)
    assert run(spark, rows, width=width, stretch=stretch) == plain(rows)


def test_one_conversation_holds_a_third_of_the_turns(spark):
    rng = np.random.default_rng(9)
    rows = [(7, i, "user", f"{i % 5}") for i in range(400)] + [(9, i, "user", f"{i % 5}") for i in range(300)]
    rows += random_rows(rng, range(100, 240), 8, 2)
    assert run(spark, rows, width=8, stretch=64) == plain(rows)


def test_without_shared_beginnings(spark):
    rows = [(c, t, "user", "hello" if t < 2 else f"{c % 3}") for c in range(30) for t in range(4)]
    got = run(spark, rows, shared=False)
    assert got == plain(rows, shared=False)
    assert [r for r in got if r[1] == 1][0][3:5] == (30, 1)


def test_odd_rows(spark):
    rows = [
        (None, 0, "user", "lost"), (200, None, "user", "first"), (200, -3, None, "second"), (200, 0, "bot", None),
        (203, 1, "user", "x"), (203, 1, "user", "x"), (-5, 0, "user", "y"), (-5, 1, None, None), (-105, 0, "", ""),
        (2**62 + 1, 5, "user", "z" * 5000), (305, 0, "user", ""), (306, 0, "user", None),
    ]
    rows += [(c, 0, "user", "only") for c in range(201, 230) if c != 203]
    got = run(spark, rows)
    assert got == plain(rows)
    root = next(r for r in got if r[1] == 0)
    assert root[2] is None and root[3] == len({r[0] for r in rows} - {None})


def test_turnless_only_and_empty(spark):
    assert run(spark, []) == []
    assert run(spark, [(None, 0, "user", "x")]) == []
    ids = [c for c in range(1, 100) if zlib.crc32(str(c).encode()) % 6 > 1][:40]
    rows = [(c, 0, "user", "gone") for c in ids]
    got = run(spark, rows)
    assert got == plain(rows) and len(got) == 1 and got[0][3:6] == (40, 0, 1)


def test_sql_agrees(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = [r for r in random_rows(rng, range(90, 190), 6)]
    want = plain(rows)
    with duckdb.connect() as db:
        db.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
        db.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
        assert sorted(db.execute(prefix_trie.ORACLE_SQL).fetchall(), key=str) == want
