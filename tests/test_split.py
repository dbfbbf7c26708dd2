import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gapcast.operators import permute, slices, split
from gapcast.plans.layout import positions
from tests.helpers import START, collect, lopsided, ordered, ramp


@pytest.fixture(scope="module")
def numbered(spark):
    return positions(spark.createDataFrame(lopsided()), ["ds", "tie", "y"], chunks=5)


def test_split_sizes_truncate(spark):
    df = split.split(ramp(spark, {"a": list(range(13)), "b": [1, 2]}))
    sizes = {(r.series_id, r.split): r["count"] for r in df.groupBy("series_id", "split").count().collect()}
    assert sizes == {("a", "train"): 7, ("a", "val"): 2, ("a", "test"): 4, ("b", "train"): 1, ("b", "test"): 1}


def _expected_windows(n, length, stride=1):
    """Window i covers i..i+length-1 inside a split of the rows that have a target."""
    n_train, n_val = int(0.6 * n), int(0.2 * n)
    usable = n - length
    bounds = {"train": (0, n_train), "val": (n_train, n_train + n_val), "test": (n_train + n_val, usable)}
    out = []
    for name, (a, b) in bounds.items():
        b = min(b, usable)
        out += [(name, i) for i in range(a, b - length + 1, stride)]
    return out


@pytest.mark.parametrize("length,stride,block", [(5, 1, 8), (12, 1, 64), (5, 3, 8)])
def test_windows(numbered, length, stride, block):
    built = split.make_windows(numbered, ["y", "idx"], length=length, stride=stride, block_rows=block)
    want = ordered(lopsided())
    rows = built.collect()
    got = {}
    for r in rows:
        got.setdefault(r.series_id, []).append((r.split, r.start_idx))
    for name, series in want.groupby("series_id"):
        assert sorted(got.get(name, [])) == sorted(_expected_windows(len(series), length, stride)), name
    values = {name: s["y"].tolist() for name, s in want.groupby("series_id")}
    for r in rows:
        y = values[r.series_id]
        assert [f.idx for f in r.features] == list(range(r.start_idx, r.start_idx + length))
        assert [f.y for f in r.features] == y[r.start_idx : r.start_idx + length]
        assert r.target == y[r.target_idx] and r.target_idx == r.start_idx + length


def test_windows_of_one_split_only(numbered):
    every = split.make_windows(numbered, ["y"], length=6, block_rows=16)
    test = split.make_windows(numbered, ["y"], length=6, splits=["test"], block_rows=16)
    assert test.exceptAll(every.where("split = 'test'")).count() == 0
    assert test.count() == every.where("split = 'test'").count()


def test_windows_keep_null_features(spark):
    df = ramp(spark, {"a": [1.0, None, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0, 9.0, 10.0]})
    first = split.make_windows(df, ["y"], length=3).where("start_idx = 0").first()
    assert [f.y for f in first.features] == [1.0, None, 3.0] and first.target == 4.0


def test_shuffled_batches_repeat(numbered):
    windows = split.make_windows(numbered, ["y"], length=4, splits=["train"]).drop("features")
    keyed = lambda seed, chunks: {
        (r.series_id, r.start_idx): (r.place, r.batch)
        for r in split.shuffle_batches(windows, seed, batch=50, chunks=chunks).collect()
    }
    one, again, other = keyed(1, 2), keyed(1, 6), keyed(2, 2)
    assert one == again != other
    places = sorted(p for p, _ in one.values())
    assert places == list(range(len(places))) and all(b == p // 50 for p, b in one.values())
    in_order = split.ordered_batches(windows, batch=50).orderBy("place").collect()
    assert [(r.series_id, r.start_idx) for r in in_order] == sorted((r.series_id, r.start_idx) for r in in_order)


def test_network_is_a_permutation():
    for total in [1, 2, 3, 5, 8, 9, 10, 97, 1000, 4097]:
        seen = [permute.permuted(np.arange(total), total, seed) for seed in range(4)]
        assert all(sorted(s.tolist()) == list(range(total)) for s in seen)
    big = permute.permuted(np.arange(10_000), 10**12 + 7, 3)
    assert len(set(big.tolist())) == 10_000 and big.min() >= 0 and big.max() < 10**12 + 7
    # Neighbours part, and places are even over the range.
    moved = permute.permuted(np.arange(20_000), 20_000, 5)
    assert abs(np.corrcoef(np.arange(20_000), moved)[0, 1]) < 0.03
    assert np.abs(np.histogram(moved[:2_000], 10, (0, 20_000))[0] - 200).max() < 60


@pytest.mark.parametrize("keys", [range(40), range(7, 700, 9), [0, 2, 3], [5, 5, 7], [4], [0, 1, 1, 3], [0, 0, 2, 2]])
def test_ranks_are_the_order_of_the_keys(spark, keys):
    rows = [(s, k, k * 10) for s in "cab" for k in keys] + [("d", 3, 0)]
    got = permute.ranked(spark.createDataFrame(rows, "series_id string, k int, v int").repartition(5), ["series_id", "k"])
    out = got.collect()
    assert sorted(r["rank"] for r in out) == list(range(len(rows))) and {r._total for r in out} == {len(rows)}
    assert [(r.series_id, r.k, r.v) for r in sorted(out, key=lambda r: r["rank"])] == sorted(rows)
    assert permute.ranked(got.select("series_id", "k").limit(0), ["series_id", "k"]).count() == 0


def test_shuffled_rows_are_not_sorted(numbered):
    windows = split.make_windows(numbered, ["y"], length=4, splits=["train"]).drop("features")
    plan = split.shuffle_batches(windows, 1)._jdf.queryExecution().toString()
    assert "rangepartitioning" not in plan.lower()


@pytest.mark.parametrize("horizon,step", [(1, 1), (3, 1), (2, 4)])
def test_rolling_origin(spark, horizon, step):
    n = 23
    df = ramp(spark, {"a": [float(i) for i in range(n)], "b": [1.0]})
    got = collect(
        split.rolling_origin(df, horizon=horizon, step=step, block_rows=4).select("cutoff_idx", "ahead", "idx", "y"),
        "cutoff_idx",
        "ahead",
    )
    n_test = int(0.2 * n)
    cutoffs = [c for c in range(n - n_test - 1, n - horizon) if (c - (n - n_test - 1)) % step == 0]
    assert got == [(c, k, c + k, float(c + k)) for c in cutoffs for k in range(1, horizon + 1)]
    first = split.rolling_origin(df, horizon=horizon, step=step).orderBy("idx").first()
    assert first.cutoff == START + pd.Timedelta(minutes=10 * first.cutoff_idx)


def test_pad_history(spark):
    df = ramp(spark, {"long": [float(i) for i in range(9)], "short": [5.0, 6.0]})
    got = collect(split.pad_history(df, 4).select("series_id", "step", "y", "is_pad"), "series_id", "step")
    assert got == [
        *[("long", k, 5.0 + k, False) for k in range(4)],
        ("short", 0, 5.0, True),
        ("short", 1, 5.0, True),
        ("short", 2, 5.0, False),
        ("short", 3, 6.0, False),
    ]


def test_future_rows(spark):
    df = ramp(spark, {"a": [1.0, 2.0], "b": [3.0]})
    longer = split.append_future_row(df, horizon=2)
    ahead = collect(longer.where("is_future").select("series_id", "idx", "ds", "y"), "series_id", "idx")
    base = START.to_pydatetime()
    assert ahead == [
        ("a", 2, base + dt.timedelta(minutes=10, hours=1), None),
        ("a", 3, base + dt.timedelta(minutes=10, hours=2), None),
        ("b", 1, base + dt.timedelta(hours=1), None),
        ("b", 2, base + dt.timedelta(hours=2), None),
    ]


def test_history_future_and_alignment(spark):
    df = split.history_future_split(ramp(spark, {"a": [1.0, 2.0, 3.0], "b": [9.0]}), 2)
    assert collect(df.select("series_id", "idx", "part"), "series_id", "idx") == [
        ("a", 0, "history"),
        ("a", 1, "future"),
        ("a", 2, "future"),
        ("b", 0, "future"),
    ]
    history, future = df.where("part = 'history'"), df.where("part = 'future'")
    got = collect(
        split.align_future(history, future, horizon=2).select("series_id", "step", "ds", "aligned"), "series_id", "step"
    )
    base = START.to_pydatetime()
    assert got == [
        ("a", 1, base + dt.timedelta(hours=1), True),
        ("a", 2, base + dt.timedelta(hours=2), True),
        ("b", 1, base, False),
    ]


def test_slices(spark):
    df = ramp(spark, {"a": [float(i) for i in range(30)], "b": [0.0, 1.0]})
    assert [r.y for r in slices.tail(df, 3).where("series_id = 'a'").orderBy("idx").collect()] == [27.0, 28.0, 29.0]
    assert slices.head(df, 5).count() == 7
    assert slices.positional_slice(df, 4, 6).count() == 2
    ticks = collect(slices.slice_ticks(df, 0, 20).where("series_id = 'a'").select("tick", "idx", "label"), "tick")
    assert [t[1] for t in ticks] == [0, 2, 5, 8, 10, 13, 16, 19] and ticks[1][2] == "2024-01-01 00:20"
    assert [r.y for r in slices.latest(df, 2, ["ds"]).collect()] == [29.0, 28.0]


def test_no_look_ahead(spark):
    """Changing a value changes no cutoff's inputs at or before it."""
    from gapcast.operators.forecast import lag_features

    values = [float(i % 7) for i in range(40)]
    changed = values[:30] + [99.0] * 10
    frames = []
    for v in (values, changed):
        rows, names = lag_features(ramp(spark, {"a": v}), 3, history=["y"], block_rows=8)
        frames.append(rows.where(F.col("idx") <= 30).select("idx", *names))
    assert frames[0].exceptAll(frames[1]).count() == 0
