"""One-bit codes against brute force."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from gapcast.llm import onebit


def plain(rows, k: int = 5, is_query=lambda i: i is not None and i % 50 == 0):
    """query_id -> [(score, vec_id)], nearest first, of all rows that can be compared."""
    seen = {}
    for i, v in rows:
        if i is None or not v or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        seen[i, tuple(v)] = np.array(v, float)
    out = {}
    for (q, _), x in seen.items():
        if is_query(q):
            near = {(-float(x @ y) / (np.linalg.norm(x) * np.linalg.norm(y)), i) for (i, _), y in seen.items() if i != q and len(y) == len(x)}
            out[q] = sorted(near)[:k]
    return out


def run(spark, rows, **options):
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumn("score", F.lit("x"))
    got: dict[int, list] = {}
    for q, rank, i, score in sorted(onebit.nearest(table, F.pmod("vec_id", F.lit(50)) == 0, **options).collect()):
        got.setdefault(q, []).append((rank, i, score))
    return got


def recall(got, want) -> float:
    found = total = 0
    for q, near in want.items():
        rows = got.get(q, [])
        assert [r for r, _, _ in rows] == list(range(1, len(rows) + 1))
        floor = -near[-1][0] if near else 2.0
        total += len(near)
        found += sum(s >= floor - 1e-12 for _, _, s in rows)
    return found / max(1, total)


def vectors(rng, n: int, kind: str, dim: int = 32) -> np.ndarray:
    x = rng.normal(size=(n, dim))
    if kind == "clusters":
        x = rng.normal(size=(12, dim))[rng.integers(0, 12, n)] + 0.25 * x
    return x.astype(np.float32)


@pytest.mark.parametrize("kind", ["random", "clusters"])
def test_recall_and_exact_scores(spark, monkeypatch, kind):
    monkeypatch.setattr(onebit, "CELL", 100)
    rng = np.random.default_rng(4)
    x = vectors(rng, 2500, kind)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    want, got = plain(rows), run(spark, rows)
    assert got.keys() == want.keys()
    assert recall(got, want) >= 0.95
    for q, near in got.items():
        for _, i, score in near:
            a, b = x[q].astype(float), x[i].astype(float)
            assert i != q and abs(score - a @ b / np.linalg.norm(a) / np.linalg.norm(b)) < 1e-12


def test_error_bounds_hold_and_prune():
    x = onebit.unit([v.astype(float).tobytes() for v in vectors(np.random.default_rng(1), 1500, "random", 64)])
    index = onebit.Index(x, 3000)
    cells = index.cells(x)
    bits, length, aligned, to_centre = index.encode(x, cells)
    inside = total = 0
    for cell in np.unique(cells):
        own = cells == cell
        guess, error = index.estimate(int(cell), x[:200], bits[own], length[own], aligned[own], to_centre[own])
        apart = np.abs(guess - x[:200] @ x[own].T)
        inside, total = inside + int((apart <= error).sum()), total + apart.size
    assert inside / total > 0.98
    assert bits.shape == (1500, 8)


def test_copies_and_ties(spark):
    rng = np.random.default_rng(2)
    hot = rng.normal(size=8).astype(np.float32).tolist()
    rows = [(i, hot) for i in range(700)] + [(1000 + i, v.tolist()) for i, v in enumerate(vectors(rng, 200, "random", 8))]
    rows += [(5000 + i, [2 * x for x in hot]) for i in range(3)]
    got = run(spark, rows)
    assert [i for _, i, _ in got[0]] == [1, 2, 3, 4, 5]
    assert [i for _, i, _ in got[100]] == [0, 1, 2, 3, 4]
    assert recall(got, plain(rows)) >= 0.95


def test_odd_rows(spark):
    rows = [
        (0, [1.0, 0.0]), (50, [0.0, 0.0]), (100, None), (150, []), (200, [float("nan"), 1.0]), (250, [float("inf"), 1.0]),
        (300, [None, 1.0]), (None, [1.0, 0.0]), (1, [0.5, 0.5]), (1, [0.5, 0.5]), (2, [-1.0, 0.0]), (0, [0.0, 3.0]),
        (350, [1.0, 2.0, 3.0]), (400, [1e-30, 0.0]), (3, [3e38, 1e38]),
    ]
    got = run(spark, rows)
    want = plain([(i, v if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows])
    # Id 0 stands for two vectors; each row's candidates are those of other ids.
    assert set(got) == {0, 400}
    assert [i for _, i, _ in got[400]] == [i for _, i in want[400]] == [0, 3, 1, 0, 2]
    assert all(i != 0 for _, i, _ in got[0])


def test_few_candidates_and_empty_table(spark):
    assert run(spark, []) == {}
    assert run(spark, [(50, [1.0, 2.0])]) == {}
    got = run(spark, [(50, [1.0, 2.0]), (51, [2.0, 1.0]), (52, [1.0, 1.0])])
    assert [i for _, i, _ in got[50]] == [52, 51]
