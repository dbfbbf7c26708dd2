import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from gapcast.config import Config
from gapcast.operators import clean, columns
from gapcast.operators.weather import join_monthly_static, join_weather
from gapcast.plans.features import clean_arrivals, feature_table, written_columns
from gapcast.plans.layout import positions
from gapcast.plans.scratch import store
from gapcast.sources import requests, sinks, tables
from tests.helpers import collect, ramp


def test_required_columns():
    class Frame:
        columns = ["arrival_date", "mbt"]

    with pytest.raises(ValueError, match="duration.*dow"):
        columns.require_columns(Frame())


def test_column_steps(spark):
    df = spark.createDataFrame([("x", 1.0, None)], "ds string, a double, mbt double")
    assert columns.split_features_target(df) == (["a", "mbt"], "mbt", True)
    assert columns.split_features_target(df.withColumnRenamed("mbt", "z")) == (["a", "z"], "z", False)
    assert columns.with_series_id(df, "L").first().series_id == "L"
    assert columns.rename_canonical(df.withColumnRenamed("ds", "arrival_date")).columns == ["ds", "a", "y"]
    assert columns.drop_helpers(df.withColumn("year", F.lit(1))).columns == df.columns
    assert columns.default_column(df, "mbt").first().mbt == 0.0


def test_cleaning_drops_missing_values_and_reports_them(spark):
    rows = [(5.0, 5.0), (-1.0, 5.0), (None, 5.0), (60.0, 5.0), (55.0, 35.0), (5.0, 35.1), (5.0, None), (5.0, -3.0)]
    df = spark.createDataFrame(rows, "duration double, mbt double").withColumn("arrival_date", F.lit("2024-06-01").cast("timestamp"))
    rules = clean.cleaning_rules()
    assert clean.clean(df, rules).count() == 3
    report = collect(clean.clean_report(df, rules).select("step", "rows_before", "rows_after", "removed"), "step")
    assert report == [(1, 8, 6, 2), (2, 6, 5, 1), (3, 5, 3, 2)]
    assert clean.drop_nulls(df).count() == 6 and clean.drop_nulls(df, ["mbt"]).count() == 7


def test_year_and_date_filters(spark):
    stamps = ["2022-12-31 23:59:59", "2023-01-01", "2024-12-31 23:59:59", "2025-01-01", "2026-06-01"]
    df = spark.createDataFrame([(s,) for s in stamps], "t string").select(F.col("t").cast("timestamp").alias("arrival_date"))
    assert df.where(clean.in_years([2024, 2023])).count() == 2
    assert df.where(clean.in_years([2022, 2026])).count() == 2
    assert df.where(clean.from_date("2024-01-01")).count() == 3


def test_filters_reach_the_scan(spark):
    rows = [("2024-01-01", 1.0, 2.0, 0, "unused")]
    df = store(spark.createDataFrame(rows, "arrival_date string, duration double, mbt double, dow int, extra string").withColumn("arrival_date", F.col("arrival_date").cast("timestamp")), "scan")
    spark.conf.set("spark.sql.maxMetadataStringLength", 2000)
    plan = clean.clean(df, clean.cleaning_rules(weather=True)).select("mbt")._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    for pushed in ("GreaterThanOrEqual(duration", "LessThanOrEqual(duration", "LessThanOrEqual(mbt", "GreaterThanOrEqual(arrival_date"):
        assert pushed in plan
    assert "extra" not in plan


def test_station_filter(spark):
    df = spark.createDataFrame([("A", None), (None, "B"), ("C", "A"), ("A", "B"), (None, None)], "device_id string, station_id string")
    few = clean.station_filter(df, ["A", "B"])
    many = clean.station_filter(df, spark.createDataFrame([("A",), ("B",)], "target string"))
    assert few.count() == many.count() == 4


WEATHER = [("2024-01-01 00:00:00", 1.0, 10.0), ("2024-01-01 02:00:00", None, 30.0), ("2024-01-01 04:00:00", 5.0, None)]


@pytest.fixture(scope="module")
def weather(spark):
    raw = spark.createDataFrame(WEATHER, "datetime string, temp double, precip double")
    return raw.withColumn("datetime", F.col("datetime").cast("timestamp"))


def _at_hours(spark, *hours):
    rows = pd.DataFrame({"series_id": "a", "ds": [pd.Timestamp("2024-01-01") + pd.Timedelta(hours=h) for h in hours]})
    return positions(spark.createDataFrame(rows), ["ds"], chunks=2)


def test_weather_is_filled_from_rows_not_from_the_table(spark, weather):
    # No arrival falls on hour 0, so hour 1 has nothing to fill from.
    df = join_weather(_at_hours(spark, 1.1, 2.0, 2.5, 3.0, 4.2, 5.0), weather, back=False)
    got = collect(df.select("idx", "temp", "precip"), "idx")
    assert got == [(0, None, None), (1, None, 30.0), (2, None, 30.0), (3, None, 30.0), (4, 5.0, 30.0), (5, 5.0, 30.0)]
    back = collect(join_weather(_at_hours(spark, 1.1, 2.0, 4.2), weather).select("idx", "temp", "precip"), "idx")
    assert back == [(0, 5.0, 30.0), (1, 5.0, 30.0), (2, 5.0, 30.0)]


def test_weather_rules(spark, weather):
    df = _at_hours(spark, 0.0)
    assert join_weather(df, None) is df
    with pytest.raises(ValueError, match="several rows"):
        join_weather(df, weather.unionAll(weather))
    shifted = join_weather(_at_hours(spark, 5.0), weather, tz="America/New_York").first()
    assert shifted.temp == 1.0


def test_monthly_static(spark):
    monthly = spark.createDataFrame([("2024-01", 4)], "month_id string, causes int")
    got = join_monthly_static(_at_hours(spark, 1, 24 * 40), monthly)
    assert collect(got.select("month_id", "causes"), "month_id") == [("2024-01", 4), ("2024-02", None)]


def test_csv_sources(spark, tmp_path):
    path = tmp_path / "arrivals.csv"
    path.write_text("arrival_date,duration,mbt,dow\n2024-01-01 00:00:00.123456+00:00,5.5,3,1\n\n2024-01-02 00:00:00,,4,1\n")
    df = tables.read_arrivals_csv(spark, str(path))
    assert df.count() == 2 and dict(df.dtypes)["arrival_date"] == "timestamp"
    assert df.first().arrival_date.microsecond == 123456
    numbers, target = tables.read_positional(spark, str(path))
    assert target == "mbt" and numbers.columns == ["duration", "mbt", "dow"]
    assert collect(numbers, "mbt") == [(5.5, 3.0, 1.0), (None, 4.0, 1.0)]
    short = tmp_path / "short.csv"
    short.write_text("arrival_date,mbt\n")
    with pytest.raises(ValueError):
        tables.read_arrivals_csv(spark, str(short))
    sky = tmp_path / "weather.csv"
    sky.write_text("name,datetime,windspeed,temp\nx,2024-01-01 01:00:00,3,40.5\n")
    assert tables.read_weather(spark, str(sky)).columns == ["datetime", "temp", "windspeed"]
    assert tables.read_weather(spark, str(tmp_path / "none.csv")) is None and tables.read_weather(spark, None) is None


def test_extract(spark):
    spark.createDataFrame([(1, 2.0, 3.0, 0, "x")], "arrival_date int, duration double, mbt double, dow int, other string").createOrReplaceTempView("arrivals")
    assert tables.extract(spark).columns == ["arrival_date", "duration", "mbt", "dow"]


def test_writers(spark, tmp_path):
    scaler = spark.createDataFrame([("a", "y", 1.0, 2.0)], "series_id string, feature string, mean double, std double")
    sinks.write_scaler(scaler, str(tmp_path / "scaler"))
    assert spark.read.parquet(str(tmp_path / "scaler")).collect() == scaler.collect()
    document = spark.createDataFrame([([("mae", 1.5, "RAW")],)], "metrics array<struct<name:string,numberValue:double,format:string>>")
    sinks.write_metrics(document, str(tmp_path / "metrics"))
    text = "".join(part.read_text() for part in (tmp_path / "metrics").glob("part-*.json"))
    assert json.loads(text) == {"metrics": [{"name": "mae", "numberValue": 1.5, "format": "RAW"}]}
    sinks.write_table(scaler, str(tmp_path / "csv"), "csv")
    heads = {part.read_text().splitlines()[0] for part in (tmp_path / "csv").glob("part-*.csv") if part.stat().st_size}
    assert heads == {"series_id,feature,mean,std"}


def _payloads(spark):
    record = {"ds": "2025-01-01 10:00:00+02:00", "unique_id": "L", "y": 1.5, "temp": 70, "extra": "x"}
    rows = {
        "wrapped": json.dumps({"instances": [record, {**record, "y": 2}]}),
        "bare": json.dumps([record]),
        "object": json.dumps({"rows": [record]}),
        "empty": json.dumps({"instances": []}),
        "scalar": "5",
        "broken": "{",
    }
    return spark.createDataFrame(list(rows.items()), "request_id string, payload string")


def test_decode_requests(spark):
    rows, errors = requests.decode_requests(_payloads(spark))
    got = collect(rows.select("request_id", "idx", "n", "unique_id", "y", "temp"), "request_id", "idx")
    assert got == [("bare", 0, 1, "L", 1.5, 70.0), ("wrapped", 0, 2, "L", 1.5, 70.0), ("wrapped", 1, 2, "L", 2.0, 70.0)]
    assert str(rows.first().ds) == "2025-01-01 10:00:00"
    assert sorted(r.request_id for r in errors.collect()) == ["broken", "empty", "object", "scalar"]
    assert errors.first().error == requests.NOT_A_LIST


def test_short_requests(spark):
    got = clean.reject_short(ramp(spark, {"a": [1.0], "b": [1.0, 2.0]}), 1).collect()
    assert [(r.series_id, r.rows) for r in got] == [("a", 1)] and got[0].error.startswith("1 rows are too few")


def test_request_and_response_json(spark):
    df = ramp(spark, {"L": [float(i) for i in range(200)]})
    payload = json.loads(requests.build_requests(df, columns=["ds", "y"]).first().payload)
    assert len(payload["instances"]) == 165
    assert payload["instances"][1] == {"unique_id": "L", "ds": "2024-01-01T00:10:00.000000", "y": 1.0}
    answer = requests.encode_response(df.where("idx >= 198").select("series_id", "idx", "y"), ["series_id"], ["idx"]).first()
    assert json.loads(answer.response) == {"predictions": [{"idx": 198, "y": 198.0}, {"idx": 199, "y": 199.0}]}


def test_feature_table_equals_pandas(spark, weather):
    rows = 400
    stamps = pd.Timestamp("2024-01-01") + pd.to_timedelta(pd.Series(range(rows)) * 13.7, unit="min")
    raw = pd.DataFrame({"arrival_date": stamps, "duration": [float((i * 37) % 70 - 5) for i in range(rows)], "mbt": [float((i * 29) % 41) for i in range(rows)], "dow": 0})
    want = raw[(raw.duration >= 0) & (raw.duration <= 55) & (raw.mbt <= 35)].copy()
    want["key"] = want.arrival_date.dt.round("h")
    sky = pd.DataFrame(WEATHER, columns=["datetime", "temp", "precip"]).astype({"datetime": "datetime64[us]"})
    want = want.merge(sky, left_on="key", right_on="datetime", how="left")
    want[["temp", "precip"]] = want[["temp", "precip"]].ffill()
    for name, fn, width in [("rolling_std_50", "std", 50), ("rolling_max_10", "max", 10), ("rolling_mean_50", "mean", 50)]:
        want[name] = getattr(want.mbt.rolling(width), fn)().bfill()
    want["dow"] = (want.arrival_date.dt.dayofweek >= 5).astype(int)
    want = want.bfill()
    for chunks in (1, 5):
        table = feature_table(spark.createDataFrame(raw.sample(frac=1, random_state=1)), weather, Config(block_rows=64), chunks=chunks)
        got = table.toPandas().sort_values("idx")
        assert got.series_id.unique().tolist() == ["E"] and len(got) == len(want)
        for mine, theirs in (("ds", "arrival_date"), ("y", "mbt"), ("dow", "dow"), ("temp", "temp"), ("precip", "precip")):
            assert got[mine].tolist() == want[theirs].tolist(), mine
        for name in ("rolling_std_50", "rolling_max_10", "rolling_mean_50"):
            assert got[name].to_numpy() == pytest.approx(want[name].to_numpy(), abs=1e-9)
    assert written_columns(table).columns[:4] == ["series_id", "ds", "duration", "y"]


def test_arrivals_before_the_weather_range_are_dropped_only_with_weather(spark, weather):
    rows = [("2023-12-31 23:00:00", 1.0, 1.0), ("2024-01-01 01:00:00", 1.0, 1.0)]
    df = spark.createDataFrame(rows, "arrival_date string, duration double, mbt double").withColumn("arrival_date", F.col("arrival_date").cast("timestamp"))
    assert clean_arrivals(df).count() == 2 and clean_arrivals(df, weather=True).count() == 1


def test_not_a_number_is_missing(spark, tmp_path):
    (tmp_path / "nan.csv").write_text("arrival_date,duration,mbt,dow\n2024-01-01T00:00:00,NaN,5.0,0\n2024-01-01T00:10:00,3.0,nan,0\n")
    rows = sorted(tables.read_arrivals_csv(spark, str(tmp_path / "nan.csv")).collect(), key=lambda r: r.arrival_date)
    assert rows[0].duration is None and rows[0].mbt == 5.0 and rows[1].duration == 3.0
    frame = spark.createDataFrame([(float("nan"), 5.0), (3.0, 5.0)], "duration double, mbt double")
    report = {r.rule: r.removed for r in clean.clean_report(frame, clean.cleaning_rules()).collect()}
    assert report["duration_min"] == 1 and report["duration_max"] == 0


def test_a_request_keeps_further_columns(spark):
    from pyspark.sql import types as T

    payload = '{"instances": [{"ds": "2024-01-01T00:00:00", "unique_id": "a", "y": 1.0, "crowd": 4}]}'
    frame = spark.createDataFrame([(1, payload)], "request_id int, payload string")
    rows, _ = requests.decode_requests(frame, extra=T.StructType([T.StructField("crowd", T.IntegerType())]))
    assert rows.first().crowd == 4 and rows.first().y == 1.0
