import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gapcast.functions.messages import parse_updates
from gapcast.operators import clean
from gapcast.operators.arrivals import detect_arrivals
from gapcast.operators.rolling import headways
from gapcast.sources.polled import read_polled_updates
from gapcast.sources.sinks import prediction_documents, replace_batch, write_predictions
from gapcast.sources.tables import read_predictions, read_vehicle_updates, stored_documents
from gapcast.streaming import cleaned, late, live
from tests.helpers import collect

BATCHES = 5


def _observations(rows=600, stations=4, seed=5):
    """ETA polls of a few stations; one has half of all rows."""
    rng = np.random.default_rng(seed)
    at = np.sort(rng.integers(0, 86_400_000_000 * 3, rows))
    station = rng.choice([f"S{k}" for k in range(stations)], rows, p=[0.5, 0.3, 0.15, 0.05])
    eta = np.round(rng.uniform(0, 20, rows), 2)
    return pd.DataFrame({"series_id": station, "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(at, unit="us"), "eta": eta})


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """The observations as JSON lines, in several files in time order, shuffled inside."""
    where = tmp_path_factory.mktemp("messages")
    table = _observations()
    for k, part in enumerate(np.array_split(np.arange(len(table)), BATCHES)):
        lines = [
            json.dumps({"station_id": r.series_id, "timestamp": str(r.ts), "minutes_until_arrival": r.eta})
            for r in table.iloc[part].sample(frac=1, random_state=k).itertuples()
        ]
        path = where / f"{k}.json"
        path.write_text("\n".join(lines))
        # The source reads files in the order of their times.
        import os

        os.utime(path, (1_700_000_000 + k, 1_700_000_000 + k))
    return str(where)


def _put(folder, name, rows):
    """A file of messages (station, time, ETA), later than those before it."""
    import os

    lines = [json.dumps({"station_id": s, "timestamp": f"2024-01-01 {t}", "minutes_until_arrival": e}) for s, t, e in rows]
    (folder / name).write_text("\n".join(lines))
    at = 1_700_000_000 + len(list(folder.glob("*.json")))
    os.utime(folder / name, (at, at))


def _run(stream, path, checkpoint):
    query = stream.writeStream.format("parquet").option("path", str(path)).option("checkpointLocation", str(checkpoint))
    query = query.outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()


def _stream(spark, folder):
    return live.parse_stream(read_vehicle_updates(spark, folder, files_per_batch=1))


def _passed(at="ts"):
    """The rows that the last watermark has passed."""
    last = _observations().ts.max().floor("ms") - pd.Timedelta(minutes=2)
    return F.col(at) <= F.lit(last.to_pydatetime())


def _batch(spark, folder):
    lines = spark.read.text(folder).withColumnRenamed("value", "message")
    rows = parse_updates(lines)
    return rows.select(F.col("target").alias("series_id"), F.col("timestamp").cast("timestamp").alias("ts"), "eta")


def test_arrivals_equal_the_batch(spark, folder):
    live_rows = live.run_available(live.detect_arrivals_stream(_stream(spark, folder)), "arrivals")
    batch_rows = detect_arrivals(_batch(spark, folder), ["ts"], chunks=4).select("series_id", "ts", "eta", "arrival").where(_passed())
    assert collect(live_rows, "series_id", "ts") == collect(batch_rows, "series_id", "ts")
    assert live_rows.where("arrival").count() > 50


def test_features_equal_the_batch(spark, folder):
    stream = live.stream_features(_stream(spark, folder), history=60)
    got = live.run_available(stream, "features").toPandas().sort_values(["series_id", "ds"])
    arrivals = detect_arrivals(_batch(spark, folder), ["ts"], chunks=4).where("arrival")
    gaps = headways(arrivals.select("series_id", F.col("ts").alias("ds")), last_n=None, chunks=3)
    want = gaps.where(_passed("ds")).toPandas().sort_values(["series_id", "ds"])
    assert got[["series_id", "ds", "y"]].values.tolist() == want[["series_id", "ds", "y"]].values.tolist()
    for name, part in got.groupby("series_id"):
        y = part.y.to_numpy()
        padded = pd.Series(np.concatenate([np.full(60, y[0]), y]))
        np.testing.assert_allclose(part.rolling_mean_10, padded.rolling(10).mean()[60:])
        np.testing.assert_allclose(part.rolling_std_50, padded.rolling(50).std()[60:], atol=1e-9)
        for k, history in enumerate(part.history):
            assert list(history) == padded[k + 1 : k + 61].tolist()


def test_state_is_bounded(spark, folder):
    short = live.stream_features(_stream(spark, folder), history=3)
    out = live.run_available(short, "short").toPandas()
    assert out.history.map(len).max() == 3


def test_snapshots_close_with_the_watermark(spark, folder):
    got = live.run_available(live.tumbling_snapshots(_stream(spark, folder)), "snapshots").toPandas()
    table = _observations()
    closed = table.ts.max() - pd.Timedelta(minutes=2)
    table["window_start"] = table.ts.dt.floor("min")
    want = table.sort_values("ts").groupby(["series_id", "window_start"]).eta.agg(["count", "min", "last"]).reset_index()
    want = want[want.window_start + pd.Timedelta(minutes=1) <= closed.floor("ms")]
    got = got.sort_values(["series_id", "window_start"])
    assert got[["series_id", "window_start", "updates", "min_eta", "last_eta"]].values.tolist() == want.values.tolist()


def test_late_rows_are_dropped_and_counted(spark, tmp_path):
    import os

    # Rows are late against the watermark of the batch before last.
    texts = [("B", f"2024-01-01 {t}") for t in ("10:00:00", "10:00:30", "09:00:00", "10:30:00")]
    for k, (station, stamp) in enumerate(texts):
        path = tmp_path / f"{k}.json"
        path.write_text(json.dumps({"station_id": station, "timestamp": stamp, "minutes_until_arrival": 1}))
        os.utime(path, (1_700_000_000 + k, 1_700_000_000 + k))
    snapshots = live.tumbling_snapshots(_stream(spark, str(tmp_path)))
    query = (
        snapshots.writeStream.format("memory").queryName("late").outputMode("append").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    dropped = sum(s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"])
    assert dropped == 1 and spark.table("late").count() == 1
    assert live.freshness(query)["watermark"] is not None


def test_trips_equal_the_batch(spark, tmp_path):
    at = lambda m: f"2024-01-01 {10 + m // 60:02d}:{m % 60:02d}:00"
    rows = [(1, "o", at(0)), (2, "o", at(5)), (3, "o", at(7)), (1, "t", at(17)), (2, "t", at(126)), (4, "t", at(20))]
    spark.createDataFrame(rows, "trip_id int, stop string, text string").select(
        "trip_id", "stop", F.col("text").cast("timestamp").alias("ts")
    ).coalesce(1).write.parquet(str(tmp_path / "stops"))
    stops = spark.readStream.schema("trip_id int, stop string, ts timestamp").parquet(str(tmp_path / "stops"))
    trips = live.trip_durations_stream(stops.where("stop = 'o'"), stops.where("stop = 't'"))
    assert collect(live.run_available(trips, "trips").select("trip_id", "duration"), "trip_id") == [(1, 17.0)]


def test_predictions_reach_the_store(spark, folder, tmp_path):
    weather = spark.createDataFrame([("2024-01-01 12:00:00", 40.0)], "datetime string, temp double")
    sky = weather.withColumn("datetime", F.col("datetime").cast("timestamp"))
    ahead = live.with_future_row(live.stream_features(_stream(spark, folder), history=20), sky)
    forecasts = live.score_stream(ahead, lambda: lambda batch: batch["rolling_mean_10"], ["rolling_mean_10"])
    documents = prediction_documents(forecasts.withColumn("route", F.lit("L")), "route", "series_id")
    path = str(tmp_path / "predictions")
    query = write_predictions(documents, path, str(tmp_path / "checkpoint"), availableNow=True)
    query.awaitTermination()
    newest = read_predictions(spark, path, 5)
    assert newest.columns == ["doc_id", "time", "route", "stop", "pred_mbt", "status", "created"]
    shown = newest.collect()
    assert len(shown) == 5 and shown[0].time >= shown[4].time and shown[0].doc_id.startswith("L#S")
    # A second run over the same folder finds nothing new: the sink is exactly-once.
    rows = spark.read.parquet(path).count()
    again = write_predictions(documents, path, str(tmp_path / "checkpoint"), availableNow=True)
    again.awaitTermination()
    assert spark.read.parquet(path).count() == rows


@pytest.mark.parametrize("files_per_batch", [None, 1, 2])
def test_rows_out_of_order_inside_the_watermark_count(spark, tmp_path, files_per_batch):
    import os

    # 1.0 at 10:01:00 comes after 9.0 at 10:02:00; the last file moves the watermark on.
    polls = [("10:00:00", 2.0), ("10:00:30", 1.5), ("10:02:00", 9.0), ("10:01:00", 1.0), ("10:03:00", 8.5), ("11:00:00", 8.0)]
    for k, (clock, eta) in enumerate(polls):
        path = tmp_path / f"{k}.json"
        path.write_text(json.dumps({"station_id": "A", "timestamp": f"2024-01-01 {clock}", "minutes_until_arrival": eta}))
        os.utime(path, (1_700_000_000 + k, 1_700_000_000 + k))
    updates = live.parse_stream(read_vehicle_updates(spark, str(tmp_path), files_per_batch=files_per_batch))
    rows = live.run_available(live.detect_arrivals_stream(updates), "disordered").orderBy("ts").collect()
    assert [(r.ts.strftime("%H:%M:%S"), r.eta, r.arrival) for r in rows] == [
        ("10:00:00", 2.0, False), ("10:00:30", 1.5, False), ("10:01:00", 1.0, False), ("10:02:00", 9.0, True), ("10:03:00", 8.5, False)
    ]


def test_remaining_minutes_count_from_the_poll(spark, folder):
    poll = F.col("ds") + F.expr("INTERVAL 2 MINUTES")
    scored = live.score_stream(live.stream_features(_stream(spark, folder), history=5), lambda: lambda b: b["y"], ["y"], poll_time=poll)
    rows = live.run_available(scored.select("yhat", "minutes_remaining"), "polled").collect()
    assert rows and all(abs(r.minutes_remaining - (r.yhat - 2)) < 1e-6 for r in rows)


def test_future_weather_is_filled_forward(spark, folder):
    sky = spark.createDataFrame([("2024-01-01 00:00:00", 40.0), ("2024-01-02 05:00:00", None), ("2024-01-02 09:00:00", 50.0)], "datetime string, temp double")
    sky = sky.withColumn("datetime", F.col("datetime").cast("timestamp"))
    ahead = live.with_future_row(live.stream_features(_stream(spark, folder), history=5), sky)
    rows = live.run_available(ahead.select("future_ds", "temp"), "filled").collect()
    # Rounding to the hour moves the border by half an hour.
    border = pd.Timestamp("2024-01-02 08:30:00")
    assert rows and all(r.temp == (50.0 if r.future_ds > border else 40.0) for r in rows if abs(r.future_ds - border) > pd.Timedelta(minutes=1))


def test_weather_lasts_however_late_the_events(spark, folder):
    sky = spark.createDataFrame([("2023-11-01 00:00:00", 40.0), ("2023-11-01 03:00:00", None)], "datetime string, temp double")
    sky = sky.withColumn("datetime", F.col("datetime").cast("timestamp"))
    ahead = live.with_future_row(live.stream_features(_stream(spark, folder), history=5), sky)
    rows = live.run_available(ahead.select("future_ds", "temp"), "late").collect()
    assert rows and all(r.temp == 40.0 for r in rows)


def test_state_survives_a_restart(spark, folder, tmp_path):
    """Half of the files, a stop, the rest: held rows, the last ETA and the gaps go on."""
    import os
    import shutil

    half, path, checkpoint = tmp_path / "half", tmp_path / "out", tmp_path / "checkpoint"
    half.mkdir()
    for part in ((0, 1, 2), (3, 4)):
        for k in part:
            shutil.copy2(f"{folder}/{k}.json", half / f"{k}.json")
            os.utime(half / f"{k}.json", (1_700_000_000 + k, 1_700_000_000 + k))
        _run(live.stream_features(_stream(spark, str(half)), history=4), path, checkpoint)
    whole = live.run_available(live.stream_features(_stream(spark, folder), history=4), "whole")
    # Between the runs the watermark has come further than files of one run let it.
    assert collect(spark.read.parquet(str(path)), "series_id", "ds") == collect(whole, "series_id", "ds")


def test_idle_series_lose_their_state(spark, tmp_path):
    _put(tmp_path, "0.json", [("A", "10:00:00", 1.0), ("B", "10:00:00", 1.0)])
    _put(tmp_path, "1.json", [("B", "10:04:00", 1.0)])
    _put(tmp_path, "2.json", [("B", "10:40:00", 1.0)])
    _put(tmp_path, "3.json", [("A", "11:00:00", 9.0), ("B", "11:00:00", 9.0)])
    _put(tmp_path, "4.json", [("C", "12:00:00", 1.0)])
    rows = lambda idle: {
        (r.series_id, r.ts.hour): r.arrival
        for r in live.run_available(live.detect_arrivals_stream(_stream(spark, str(tmp_path)), idle=idle), "idle").collect()
    }
    assert rows(None)["A", 11] and rows(None)["B", 11]
    short = rows("30 minutes")
    assert not short["A", 11] and short["B", 11]


def test_late_rows_are_those_spark_drops(spark, tmp_path):
    rng = np.random.default_rng(6)
    folder, path = tmp_path / "in", tmp_path / "out"
    folder.mkdir()
    for k in range(6):
        minutes = np.clip(10 * k - rng.exponential(8, 40), 0, None)
        _put(folder, f"{k}.json", [(f"S{i % 3}", f"{10 + int(m) // 60}:{int(m) % 60:02d}:{int(m * 60) % 60:02d}", float(i)) for i, m in enumerate(minutes)])
    query = live.detect_arrivals_stream(_stream(spark, str(folder))).writeStream.format("noop").trigger(availableNow=True)
    query = query.option("checkpointLocation", str(tmp_path / "one")).start()
    query.awaitTermination()
    dropped = sum(s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"])
    for again in range(2):
        # A second run on a new checkpoint writes every batch again, in place of the first.
        checkpoint = str(tmp_path / f"late{again}")
        late.split_late(_stream(spark, str(folder)), str(path), checkpoint, availableNow=True).awaitTermination()
        counts = late.late_counts(spark, str(path)).orderBy("batch").collect()
        assert [c.batch for c in counts] == list(range(6)) and sum(c.rows for c in counts) == 240
        assert sum(c.late_rows for c in counts) == late.late_rows(spark, str(path)).count() == dropped > 0
    assert late.late_rows(spark, str(path)).where("ts > watermark").count() == 0


def test_a_batch_that_runs_again_leaves_one_document(spark, tmp_path):
    at = pd.Timestamp("2024-01-01").to_pydatetime()
    columns = "doc_id string, timestamp_str string, timestamp timestamp, route_id string, stop_id string, predicted_mbt double, status string, created_at timestamp"
    rows = [(f"L#{s}", "t1", at, "L", s, 4.0, "ok", at) for s in "abc"]
    path, documents = str(tmp_path / "store"), spark.createDataFrame(rows, columns)
    for _ in range(2):
        replace_batch(documents, path, "w", 7)
    assert stored_documents(spark, path).count() == 3
    later = documents.where("stop_id = 'b'").withColumns({"created_at": F.lit(at + pd.Timedelta("1s")), "predicted_mbt": F.lit(9.0)})
    write_predictions(later, path)
    write_predictions(documents, path)
    assert collect(read_predictions(spark, path).select("stop", "pred_mbt"), "stop") == [("a", 4.0), ("b", 9.0), ("c", 4.0)]
    assert read_predictions(spark, path, versions=True).count() == 7
    with pytest.raises(ValueError):
        write_predictions(spark.readStream.schema(documents.schema).parquet(str(tmp_path)), path)


def test_polled_payloads_are_taken_once(spark, tmp_path):
    folder, path, checkpoint = tmp_path / "feed", tmp_path / "out", tmp_path / "checkpoint"
    folder.mkdir()
    updates = lambda: live.parse_stream(read_polled_updates(spark, str(folder)))
    _put(folder, "a.json", [("A", "10:00:00", 1.0), ("B", "10:00:00", 2.0)])
    _put(folder, "b.json", [("A", "10:00:30", 0.5)])
    (folder / "_hidden").write_text("{}")
    _run(updates(), path, checkpoint)
    assert spark.read.parquet(str(path)).count() == 3
    _run(updates(), path, checkpoint)
    _put(folder, "0-later.json", [("A", "10:01:00", 9.0)])
    _run(updates(), path, checkpoint)
    rows = spark.read.parquet(str(path))
    assert collect(rows.select("series_id", "eta"), "series_id", "ts") == [("A", 1.0), ("A", 0.5), ("A", 9.0), ("B", 2.0)]


def test_report_of_a_stream_comes_with_its_rows(spark, tmp_path):
    table = spark.createDataFrame([(float(k % 70) - 5, float(k % 50)) for k in range(300)], "duration double, mbt double")
    table.repartition(5).write.parquet(str(tmp_path / "in"))
    rules = clean.cleaning_rules()
    kept, counts = clean.clean_observed(table, rules)
    rows = kept.count()
    want = collect(clean.clean_report(table, rules), "step")
    assert collect(clean.observed_report(spark, counts, rules), "step") == want and want[-1][3] == rows
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    path = str(tmp_path / "out")
    cleaned.write_cleaned(stream, rules, path, str(tmp_path / "checkpoint"), availableNow=True).awaitTermination()
    assert collect(cleaned.live_report(spark, path), "step") == want
    assert cleaned.cleaned_rows(spark, path).count() == rows


def test_messages_are_written_by_many_tasks_and_parts_stay_apart(spark, tmp_path, monkeypatch):
    import glob

    from catalog import inputs

    monkeypatch.setattr(inputs, "FILE_ROWS", 50)
    # Part 1 has a single event, so fewer files than the others.
    minutes = [k * 0.001 for k in range(200)] + [30.0] + [51 + k * 0.01 for k in range(200)] + [100.0] * 2
    rows = [(k, int(m * 6e7), k % 7, "view", 1.0) for k, m in enumerate(minutes)]
    table = spark.createDataFrame(rows, "event_id long, at long, user_id long, event_type string, value double")
    table.withColumn("ts", F.timestamp_micros("at")).write.parquet(str(tmp_path / "events.parquet"))

    def by_time(files, low, high):
        return F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - low) * files / (high - low + 1))

    path, files = inputs.update_files(spark, str(tmp_path), disorder=by_time)
    assert files > 1 and len(glob.glob(path.replace("/*", "/part=0/*.txt"))) == files
    batches = []
    updates = read_vehicle_updates(spark, path, files_per_batch=files)
    query = updates.writeStream.foreachBatch(lambda batch, number: batches.append(batch.count())).option("checkpointLocation", str(tmp_path / "c"))
    query.trigger(availableNow=True).start().awaitTermination()
    assert batches == [200, 1, 200, 2]


def test_many_series_share_their_state_tables(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(live, "GROUPS", 8)
    rng = np.random.default_rng(8)
    for k in range(3):
        clock = lambda: f"{10 + k}:{rng.integers(0, 60):02d}:{rng.integers(0, 60):02d}"
        _put(tmp_path, f"{k}.json", [(f"S{i}", clock(), float(rng.integers(0, 30))) for i in range(100) for _ in range(4)])
    _put(tmp_path, "3.json", [("S0", "20:00:00", 1.0)])
    stream = live.stream_headways(_stream(spark, str(tmp_path)))
    query = stream.writeStream.format("memory").queryName("shared").trigger(availableNow=True).start()
    query.awaitTermination()
    assert 0 < max(s["numRowsTotal"] for p in query.recentProgress for s in p["stateOperators"]) < 100
    arrivals = detect_arrivals(_batch(spark, str(tmp_path)), ["ts", "eta"], chunks=2).where("arrival AND ts < '2024-01-01 19:00:00'")
    want = headways(arrivals.select("series_id", F.col("ts").alias("ds")), last_n=None, chunks=2).select("series_id", "ds", "y")
    got = spark.table("shared")
    assert got.select("series_id").distinct().count() > 50
    assert collect(got, "series_id", "ds") == collect(want, "series_id", "ds")
