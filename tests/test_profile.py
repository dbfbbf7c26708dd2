import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gapcast.config import QUANTILE_LEVELS
from gapcast.operators import profile, scaling, spectral, split
from gapcast.operators import quantiles as selection
from gapcast.operators.quantiles import quantile_columns, quantiles
from gapcast.plans.layout import positions
from tests.helpers import lopsided, ramp


@pytest.fixture(scope="module")
def table():
    return lopsided()


@pytest.fixture(scope="module")
def numbered(spark, table):
    return positions(spark.createDataFrame(table), ["ds", "tie", "y"], chunks=5)


def test_quantiles_of_four(spark):
    df = ramp(spark, {"a": [4.0, 1.0, 3.0, 2.0, None]})
    got = {r.level: r["quantile"] for r in quantiles(df, "y", [0.001, 0.25, 0.5]).collect()}
    assert got == pytest.approx({0.001: 1.003, 0.25: 1.75, 0.5: 2.5})


@pytest.mark.parametrize("limit", [40, 1_000_000])
def test_quantiles_equal_numpy(numbered, table, limit, monkeypatch):
    # A coarse sketch and a low limit send the gaps through several rounds.
    monkeypatch.setattr(selection, "ACCURACY", 20 if limit < 1_000 else 10_000)
    got = quantiles(numbered, "y", limit=limit).toPandas().set_index(["series_id", "level"])["quantile"]
    for name, part in table.groupby("series_id"):
        for p in QUANTILE_LEVELS:
            assert got[name, p] == pytest.approx(np.quantile(part.y, p), abs=1e-12), (name, p)


def test_quantiles_by_sketch_return_values(numbered, table):
    got = quantiles(numbered, "y", [0.5], exact=False).toPandas()
    assert set(got["quantile"]) <= set(table.y)


def test_quantiles_under_one_hot_value(spark):
    rows = pd.DataFrame({"series_id": "a", "v": [0.0] * 3000 + list(np.arange(1, 1001.0))})
    got = quantile_columns(spark.createDataFrame(rows), "v", {"low": 0.5, "high": 0.9}, limit=50).first()
    assert (got.low, got.high) == (0.0, pytest.approx(np.quantile(rows.v, 0.9)))


def test_quantiles_of_odd_groups(spark):
    rows = [("one", 7.0), ("two", 1.0), ("two", 2.0), ("ties", 5.0), ("ties", 5.0), ("ties", 5.0), ("none", None), ("null", None), ("null", 4.0)]
    rows += [("nan", float("nan")), ("nan", 1.0), ("nan", 2.0), ("zero", -0.0), ("zero", 0.0), ("all nan", float("nan")), ("inf", float("inf")), ("inf", -1.0)]
    df = spark.createDataFrame(rows, "series_id string, v double")
    got = {(r.series_id, r.level): r["quantile"] for r in quantiles(df, "v", [0.0, 0.5, 1.0], limit=1).collect()}
    assert [got["one", p] for p in (0.0, 0.5, 1.0)] == [7.0] * 3 and [got["ties", p] for p in (0.0, 0.5, 1.0)] == [5.0] * 3
    assert [got["two", p] for p in (0.0, 0.5, 1.0)] == [1.0, 1.5, 2.0] and got["null", 0.5] == 4.0 and ("none", 0.5) not in got
    assert [got["nan", p] for p in (0.0, 0.5)] == [1.0, 2.0] and np.isnan(got["nan", 1.0]) and np.isnan(got["all nan", 0.5])
    assert got["zero", 1.0] == 0.0 and got["inf", 0.0] == -1.0 and got["inf", 1.0] == float("inf")
    assert quantiles(df.limit(0), "v").collect() == []


def test_quantiles_without_groups_and_of_long_integers(spark):
    rows = [(2**60 + k, k) for k in range(101)]
    df = spark.createDataFrame(rows, "v bigint, other bigint")
    got = {r.level: r["quantile"] for r in quantiles(df, "other", [0.25, 0.5], by=(), limit=5).collect()}
    assert got == {0.25: 25.0, 0.5: 50.0}
    assert quantile_columns(df, "v", {"mid": 0.5}, by=()).first().mid == float(2**60 + 50)


def test_quantiles_move_counts_and_not_rows(numbered):
    plan = quantiles(numbered, "y")._jdf.queryExecution().toString()
    assert "RangePartitioning" not in plan and "rangepartitioning" not in plan


def test_describe(numbered, table):
    got = profile.describe(numbered, ["y"]).toPandas().set_index("series_id")
    want = table.groupby("series_id")["y"].describe()
    for mine, theirs in (("count", "count"), ("mean", "mean"), ("std", "std"), ("min", "min"), ("q25", "25%"), ("q50", "50%"), ("q75", "75%"), ("max", "max")):
        np.testing.assert_allclose(got.loc[want.index, mine].astype(float), want[theirs], err_msg=mine)


@pytest.mark.parametrize("bins", [10, 30])
def test_histogram_equals_numpy(numbered, table, bins):
    got = profile.histogram(numbered, "y", bins).toPandas().sort_values(["series_id", "bin"])
    density = profile.histogram(numbered, "y", bins, density=True).toPandas().sort_values(["series_id", "bin"])
    for name, part in table.groupby("series_id"):
        counts, edges = np.histogram(part.y, bins)
        mine = got[got.series_id == name]
        assert mine["count"].tolist() == counts.tolist()
        np.testing.assert_allclose(mine.lower, edges[:-1])
        np.testing.assert_allclose(mine.upper, edges[1:])
        np.testing.assert_allclose(
            density[density.series_id == name].density, np.histogram(part.y, bins, density=True)[0]
        )


def test_kde_equals_direct_sum(numbered, table):
    got = profile.kde(numbered, ["y"], points=50, bins=30).toPandas()
    assert set(got.series_id) == {"hot", "mid"}, "one value has no bandwidth"
    for name, part in table[table.series_id != "one"].groupby("series_id"):
        v = part.y.to_numpy()
        h = len(v) ** -0.2 * v.std(ddof=1)
        pad = 0.1 * (v.max() - v.min())
        x = np.linspace(v.min() - pad, v.max() + pad, 50)
        want = np.exp(-0.5 * ((x[:, None] - v) / h) ** 2).mean(axis=1) / (h * np.sqrt(2 * np.pi))
        mine = got[got.series_id == name].sort_values("point")
        np.testing.assert_allclose(mine.x, x)
        np.testing.assert_allclose(mine.density, want, rtol=1e-9, atol=1e-15)
        width = (v.max() - v.min()) / 30
        np.testing.assert_allclose(mine.curve, want * len(v) * width, rtol=1e-9, atol=1e-15)


def test_cell_expansion_keeps_its_bound(spark):
    """One row at the edge of its cell, the worst place, over the whole reach of the kernel."""
    t = np.linspace(-27, 27, 4001)
    for s in (-profile.CELL_HALF, profile.CELL_HALF):
        moments = [F.lit(s**n) for n in range(profile.MOMENTS)]
        shape = spark.range(1).select(*profile._cell_polynomial(moments)).first()
        got = np.exp(-t * t) * np.polyval(list(shape)[::-1], t)
        assert np.abs(got - np.exp(-((t - s) ** 2))).max() < 2e-15
        assert (np.abs(got - np.exp(-((t - s) ** 2))) <= 1e-14 * np.exp(-t * t / 2)).all()


def test_kde_of_lumpy_values(spark):
    rng = np.random.default_rng(8)
    v = np.concatenate([rng.normal(0, 1, 2000), rng.normal(1e4, 1e-3, 500), np.full(700, 50.0), [-3e5]])
    df = positions(spark.createDataFrame(pd.DataFrame({"series_id": "s", "ds": np.arange(len(v)), "y": v})), ["ds"], chunks=3)
    got = profile.kde(df, ["y"], points=400).toPandas().sort_values("point")
    h = len(v) ** -0.2 * v.std(ddof=1)
    want = np.exp(-0.5 * ((got.x.to_numpy()[:, None] - v) / h) ** 2).mean(axis=1) / (h * np.sqrt(2 * np.pi))
    np.testing.assert_allclose(got.density * h, want * h, rtol=1e-9, atol=1e-14)


def test_heatmap_days(spark):
    # Friday evening in New York is Saturday in UTC.
    rows = pd.DataFrame({"ds": pd.to_datetime(["2024-01-06 02:00", "2024-01-06 02:30", "2024-01-08 15:00"]), "y": [2.0, 4.0, 7.0]})
    df = spark.createDataFrame(rows)
    local = profile.present_days(profile.heatmap(df, tz="America/New_York")).toPandas()
    assert local.columns.tolist() == ["hour", "Monday", "Friday"]
    assert local.set_index("hour").loc[21, "Friday"] == 3.0 and local.set_index("hour").loc[10, "Monday"] == 7.0
    assert profile.present_days(profile.heatmap(df)).columns == ["hour", "Monday", "Saturday"]


def test_shape(numbered, table):
    assert tuple(profile.frame_shape(numbered).first()) == (len(table), len(numbered.columns))


def _power_by_fit(t, y, frequencies):
    """Power as the share of variance a sine with offset explains."""
    out = []
    base = ((y - y.mean()) ** 2).sum()
    for f in frequencies:
        a = np.column_stack([np.ones_like(t), np.cos(2 * np.pi * f * t), np.sin(2 * np.pi * f * t)])
        rest = y - a @ np.linalg.lstsq(a, y, rcond=None)[0]
        out.append(1 - (rest**2).sum() / base)
    return np.array(out)


def _sine(spark, rows=500, days=40):
    rng = np.random.default_rng(0)
    t = np.sort(rng.uniform(0, days, rows))
    y = 10 + 3 * np.sin(2 * np.pi * t) + np.sin(2 * np.pi * t / 7) + rng.normal(0, 0.5, rows)
    at = pd.Timestamp("2024-01-01") + pd.to_timedelta((t * 86_400e6).astype("int64"), unit="us")
    table = pd.DataFrame({"series_id": "s", "ds": at, "y": y})
    exact = ((at - at[0]) // pd.Timedelta(microseconds=1)).to_numpy() / 86_400e6
    return positions(spark.createDataFrame(table), ["ds"], chunks=4), exact, y


@pytest.mark.parametrize("part_cells,block", [(1 << 14, 4096), (500, 100)])
def test_spectrum(spark, monkeypatch, part_cells, block):
    """One series in one part, or split into several parts and blocks of frequencies."""
    monkeypatch.setattr(spectral, "BLOCK", block)
    df, t, y = _sine(spark)
    few = spectral.periodogram(df, [0.1, 1.0, 3.7], part_cells=part_cells).toPandas().sort_values("frequency")
    np.testing.assert_allclose(few.power, _power_by_fit(t, y, few.frequency), atol=1e-10)
    auto = spectral.autopower(df, max_frequency=6.0, part_cells=part_cells).toPandas().sort_values("frequency")
    step = 1 / (5 * (t.max() - t.min()))
    count = 1 + round((6.0 - 1 / 365.25) / step)
    np.testing.assert_allclose(auto.frequency, 1 / 365.25 + step * np.arange(count), rtol=1e-12)
    np.testing.assert_allclose(auto.power, _power_by_fit(t, y, auto.frequency), atol=1e-9)
    top = spectral.peaks(spectral.autopower(df, max_frequency=6.0), 2).toPandas().sort_values("rank")
    assert top.frequency.iloc[0] == pytest.approx(1.0, abs=step) and top.frequency.iloc[1] == pytest.approx(1 / 7, abs=step)
    assert top.per_year.iloc[0] == pytest.approx(365.25 * top.frequency.iloc[0])


def test_scalers(numbered, table):
    rows = split.split(numbered)
    fitted = scaling.fit_scaler(rows, ["y", "tie"]).toPandas().set_index(["series_id", "feature"])
    train = rows.where("split = 'train'").toPandas()
    for name, part in train.groupby("series_id"):
        assert fitted.loc[(name, "y"), "mean"] == pytest.approx(part.y.mean())
        assert fitted.loc[(name, "y"), "std"] == pytest.approx(part.y.std(ddof=0))
    robust = scaling.fit_robust_scaler(rows, ["y"]).toPandas().set_index("series_id")
    for name, part in train.groupby("series_id"):
        assert robust.loc[name, "mean"] == pytest.approx(part.y.median())
        assert robust.loc[name, "std"] == pytest.approx((part.y - part.y.median()).abs().median())


def test_flat_feature_is_reported(spark):
    rows = split.split(ramp(spark, {"a": [5.0] * 10}))
    fitted = scaling.fit_scaler(rows, ["y"])
    assert scaling.unscalable(fitted).count() == 1
    assert scaling.apply_scaler(rows, fitted, ["y"]).where("y IS NOT NULL").count() == 0
