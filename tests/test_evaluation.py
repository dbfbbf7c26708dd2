import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gapcast.config import Config
from gapcast.operators import arrivals, forecast, metrics, split
from gapcast.plans.features import add_features
from gapcast.plans.scratch import store
from gapcast.plans.training import train_and_evaluate
from tests.helpers import START, collect, ramp


@pytest.fixture(scope="module")
def scored(spark):
    rows = [("a", 10.0, 9.0, 12.0), ("a", 4.0, 6.0, 4.5), ("b", 1.0, 1.0, None), ("b", None, 3.0, 3.0)]
    return spark.createDataFrame(rows, "series_id string, y double, m1 double, m2 double")


def test_evaluate(scored):
    got = {(r.series_id, r.model, r.metric): r.value for r in metrics.evaluate(scored, ["m1", "m2"]).collect()}
    assert got["a", "m1", "mae"] == 1.5 and got["a", "m1", "rmse"] == pytest.approx(np.sqrt(2.5))
    assert got["b", "m1", "mae"] == 0.0 and got["b", "m2", "mae"] is None
    assert got["ALL", "m1", "mae"] == 1.0 and got["ALL", "m2", "mae"] == 1.25
    assert len(got) == 3 * 2 * 2


def test_pluggable_metrics(scored):
    plugged = {"bias": lambda y, p: F.avg(y - p), "huber": metrics.huber(1.0), "p90": metrics.pinball(0.9)}
    got = {r.metric: r.value for r in metrics.evaluate(scored, ["m1"], plugged).where("series_id = 'a'").collect()}
    assert got["bias"] == -0.5 and got["huber"] == 1.0
    assert got["p90"] == pytest.approx((0.9 * 1 + 0.1 * 2) / 2)


def test_compare_models(scored):
    got = {r.model: r.mae for r in metrics.compare_models(scored, ["m1", "m2"]).collect()}
    assert got == {"m1": 1.0, "m2": 1.25}


def test_residuals_and_their_unscaling(scored):
    plain = metrics.residual_frame(scored.where("series_id = 'a'"), predicted="m1").orderBy("y").first()
    assert (plain["Error"], plain["Abs Error"]) == (-2.0, 2.0)
    raw = metrics.residual_frame(scored.where("y = 4"), predicted="m1", inverse=(1.0, 3.0)).first()
    assert (raw["Actual"], raw["Predicted"], raw["Error"]) == (13.0, 19.0, -6.0)


def test_coverage_counts_borders(spark):
    df = spark.createDataFrame(
        [("a", 1.0, 1.0, 2.0), ("a", 2.0, 1.0, 2.0), ("a", 2.1, 1.0, 2.0), ("a", None, 0.0, 9.0)],
        "series_id string, y double, lo80 double, hi80 double",
    )
    got = metrics.coverage(df).first()
    assert (got.rows, got.coverage, got.mean_width) == (3, pytest.approx(2 / 3), 1.0)


def test_metrics_document(scored):
    document = metrics.metrics_document(metrics.evaluate(scored, ["m1"])).where("series_id = 'a'").first()
    assert [(m.name, m.format) for m in document.metrics] == [("mae", "RAW"), ("rmse", "RAW")]
    assert metrics.metrics_report(metrics.evaluate(scored, ["m1"])).where("series_id = 'a' AND metric = 'mae'").first().text == "1.5000"


def test_target_dates_join_by_position(spark):
    df = ramp(spark, {"a": [float(i) for i in range(40)]})
    windows = split.make_windows(df, ["y"], length=4, splits=["test"])
    dated = metrics.attach_target_dates(windows, df)
    assert dated.count() == windows.count()
    first = dated.orderBy("target_idx").first()
    # The first test target is train + val + length.
    assert first.target_idx == 24 + 8 + 4 and first.target_ds == START + pd.Timedelta(minutes=10 * 36)


def test_naive_mae_of_windows(spark):
    values = [float((i * 7) % 11) for i in range(60)]
    got = {r.split: r.mae for r in metrics.naive_mae(ramp(spark, {"a": values}), 5, block_rows=7).collect()}
    targets = range(36 + 12 + 5, 60 - 1 + 1)
    usable = [t for t in targets if t - 1 < 60 - 5]
    assert got["test"] == pytest.approx(np.mean([abs(values[t] - values[t - 1]) for t in usable]))


def test_seasonal_quantiles_fall_back_to_the_series(spark):
    df = ramp(spark, {"a": [float(i) for i in range(48)]}, minutes=30)
    model = forecast.fit_seasonal_quantiles(df.where("idx < 4"))
    got = {r.idx: (r.lo80, r.yhat, r.hi80) for r in forecast.seasonal_quantile_forecast(df, model).collect()}
    assert got[1] == pytest.approx((0.1, 0.5, 0.9)) and got[2] == pytest.approx((2.1, 2.5, 2.9))
    assert got[30] == pytest.approx((0.3, 1.5, 2.7))
    assert len(got) == 48


def test_residual_band(spark):
    df = ramp(spark, {"a": [0.0, 1.0, 2.0, 3.0, 4.0]}).withColumn("yhat", F.lit(2.0))
    got = forecast.residual_band(df, df).first()
    assert (got.lo80, got.hi80) == (pytest.approx(2 - 1.6), pytest.approx(2 + 1.6))


def test_best_by_validation(spark):
    df = ramp(spark, {"a": [1.0, 2.0], "b": [5.0, 6.0]}).withColumns(
        {
            "split": F.lit("val"),
            "m1": F.when(F.col("series_id") == "a", F.col("y")).otherwise(0.0),
            "m2": F.when(F.col("series_id") == "b", F.col("y") + 1).otherwise(0.0),
        }
    )
    best = forecast.best_by_validation(df, ["m1", "m2"])
    assert collect(best, "series_id") == [("a", "m1", 0.0), ("b", "m2", 1.0)]
    chosen = collect(forecast.chosen_forecast(df, best, ["m1", "m2"]).select("series_id", "idx", "yhat"), "series_id", "idx")
    assert chosen == [("a", 0, 1.0), ("a", 1, 2.0), ("b", 0, 6.0), ("b", 1, 7.0)]


def test_score(spark):
    df = ramp(spark, {"a": [1.0, 2.0, 3.0]})
    with pytest.raises(ValueError):
        forecast.score(df, None)
    got = forecast.score(df, lambda: lambda batch: batch["y"] * 2, features=["y"])
    assert [r.yhat for r in got.orderBy("idx").collect()] == [2.0, 4.0, 6.0]


def test_regression_learns_a_lag(spark):
    rng = np.random.default_rng(1)
    y = [5.0, 5.0]
    for _ in range(400):
        y.append(2 + 0.6 * y[-1] - 0.2 * y[-2] + float(rng.normal(0, 0.05)))
    rows, names = forecast.lag_features(ramp(spark, {"a": y}), 2)
    # Outliers in the target, which the loss must shrug off.
    rows = rows.withColumn("y", F.when(F.col("idx") % 50 == 7, 500.0).otherwise(F.col("y")))
    model = forecast.huber_regression(rows, names)
    weights = model.coefficients
    assert weights[0] == pytest.approx(0.6, abs=0.1) and weights[1] == pytest.approx(-0.2, abs=0.1)
    scored = forecast.score(rows, model, "huber").where("idx % 50 <> 7")
    assert scored.select(F.avg(F.abs(F.col("y") - F.col("huber")))).first()[0] < 0.2


def test_regression_finds_the_least_loss(spark):
    """No small step from the solution lowers the Huber loss; a flat and a repeated feature do no harm."""
    rng = np.random.default_rng(4)
    x = rng.normal(3, 2, (500, 2))
    y = 1 + x @ [0.5, -2.0] + rng.standard_t(2, 500)
    table = pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "c": x[:, 1], "flat": 7.0, "y": y})
    table.loc[499, "b"] = None
    df = spark.createDataFrame(table).withColumn("b", F.when(~F.isnan("b"), F.col("b"))).repartition(5)
    model = forecast.huber_regression(df, ["a", "b", "c", "flat"], rounds=40, ridge=1e-9)
    assert model.coefficients[3] == 0.0
    got = np.array([model.coefficients[0], model.coefficients[1] + model.coefficients[2], model.intercept])
    u = np.column_stack([x, np.ones(500)])[:499]

    def loss(w):
        e = np.abs(y[:499] - u @ w)
        return np.where(e <= 1, e * e / 2, e - 0.5).sum()

    assert all(loss(got) <= loss(got + step * axis) + 1e-6 for step in (-0.01, 0.01) for axis in np.eye(3))
    with pytest.raises(ValueError, match="no training rows"):
        forecast.huber_regression(df.limit(0), ["a"])


def test_boosted_trees_fit_a_step(spark):
    rows, names = forecast.lag_features(ramp(spark, {"a": [float(i % 4 == 0) * 9 for i in range(200)]}), 4)
    model = forecast.boosted_trees(rows, names, maxIter=2, maxDepth=2)
    got = forecast.score(rows, model, "trees")
    assert got.select(F.max(F.abs(F.col("y") - F.col("trees")))).first()[0] < 1.0


def test_training_run(spark):
    rng = np.random.default_rng(2)
    values = {s: [float(v) for v in 8 + 3 * np.sin(np.arange(300) / 9) + rng.normal(0, 0.3, 300)] for s in "ab"}
    table = ramp(spark, values, minutes=12).withColumn("duration", F.lit(3.0) + F.col("idx") % 5)
    run = train_and_evaluate(store(add_features(table, None, Config(block_rows=64), dense=True), "table"), Config(block_rows=64), lags=6)
    scores = {(r.series_id, r.model, r.metric): r.value for r in run.scores.collect()}
    assert scores["ALL", "huber", "mae"] < scores["ALL", "naive", "mae"]
    assert run.forecasts.where("cutoff >= ds OR lo80 > hi80").count() == 0
    assert run.metrics.count() == 3 * 3


def test_detect_arrivals(spark):
    etas = [3.0, 2.0, 1.0, 9.0, 8.0, 15.0]
    rows = [("a", START.to_pydatetime() + dt.timedelta(minutes=i), e) for i, e in enumerate(etas)]
    rows += [("b", START.to_pydatetime(), 1.0), ("b", START.to_pydatetime() + dt.timedelta(minutes=1), 4.0)]
    rows += [("c", START.to_pydatetime(), 1.0), ("c", START.to_pydatetime() + dt.timedelta(minutes=1), None)]
    rows += [("c", START.to_pydatetime() + dt.timedelta(minutes=2), 9.0)]
    df = spark.createDataFrame(rows[::-1], "series_id string, ts timestamp, eta double")
    got = arrivals.detect_arrivals(df, chunks=4).where("arrival").select("series_id", F.minute("ts").alias("m"))
    assert collect(got, "series_id", "m") == [("a", 3), ("a", 5), ("c", 2)]


def test_eta_forecast_may_be_negative(spark):
    df = ramp(spark, {"a": [1.0, 2.0]})
    ahead = spark.createDataFrame([("a", 2.5)], "series_id string, yhat double")
    poll = F.lit("2024-01-01 00:20:00").cast("timestamp")
    got = arrivals.eta_forecast(ahead, df, poll).first()
    assert got.predicted_arrival == dt.datetime(2024, 1, 1, 0, 12, 30) and got.minutes_remaining == -7.5
    cells = arrivals.prediction_cells(arrivals.eta_forecast(ahead, df, poll)).first()
    assert cells.row_key == "a#2024-01-01T00:20:00" and cells.predicted_minutes_remaining == "-7.5"
    assert cells.predicted_arrival_time == "2024-01-01T00:12:30" and cells.generated_at


def test_trip_durations(spark):
    at = lambda m: START.to_pydatetime() + dt.timedelta(minutes=m)
    rows = [(1, "o", at(0)), (1, "t", at(17)), (1, "t", at(30)), (2, "o", at(5)), (3, "t", at(9)), (4, "o", at(0)), (4, "t", at(121)), (5, "t", at(0)), (5, "o", at(9))]
    df = spark.createDataFrame(rows, "trip int, stop string, ts timestamp")
    got = collect(arrivals.trip_durations(df, ["trip"], "stop", "ts", "o", "t").select("trip", "duration"), "trip")
    assert got == [(1, 17.0)]


def test_latest_and_staleness(spark):
    at = lambda m: START.to_pydatetime() + dt.timedelta(minutes=m)
    df = spark.createDataFrame(
        [("L", "s", "t1", at(1), 5.0), ("L", "s", "t1", at(3), 6.0), ("L", "s", "t2", at(2), 7.0), ("L", "r", "t1", at(2), 8.0)],
        "route_id string, stop_id string, timestamp_str string, created_at timestamp, predicted_mbt double",
    )
    newest = arrivals.latest_per_key(df).select("stop_id", "timestamp_str", "predicted_mbt")
    assert collect(newest, "stop_id", "timestamp_str") == [("r", "t1", 8.0), ("s", "t1", 6.0), ("s", "t2", 7.0)]
    stale = arrivals.staleness(df, F.lit("2024-01-01 00:10:00").cast("timestamp"), "created_at", ["route_id"])
    assert stale.first().minutes_stale == 7.0
