import datetime as dt
import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from gapcast.functions import clock, numbers


def _one(spark, **columns):
    return spark.range(1).select(*[c.alias(name) for name, c in columns.items()]).first()


def _ts(text):
    return F.lit(text).cast("timestamp")


@pytest.mark.parametrize(
    "given,want",
    [("10:30:00", "10"), ("11:30:00", "12"), ("10:29:59", "10"), ("10:30:01", "11"), ("23:45:00", "00")],
)
def test_round_hour_half_to_even(spark, given, want):
    got = _one(spark, h=clock.round_hour(_ts(f"2024-03-05 {given}"))).h
    assert got.strftime("%H") == want
    assert got == pd.Timestamp(f"2024-03-05 {given}").round("h")


def test_weekend_flag(spark):
    days = {"2024-01-05": 0, "2024-01-06": 1, "2024-01-07": 1, "2024-01-08": 0}
    for day, want in days.items():
        assert _one(spark, d=clock.weekend_flag(_ts(day))).d == want


def test_cyclical_forms(spark):
    stamp = "2024-01-03 06:00:00.25"
    got = _one(spark, **clock.cyclical(_ts(stamp)))
    seconds = pd.Timestamp(stamp).timestamp()
    assert got.day_sin == pytest.approx(math.sin(seconds * 2 * math.pi / 86400), abs=1e-7)
    assert got.week_cos == pytest.approx(math.cos(seconds * 2 * math.pi / 604800), abs=1e-7)
    got = _one(spark, **clock.cyclical(_ts(stamp), form="calendar"))
    assert got.day_sin == pytest.approx(1.0) and got.week_sin == pytest.approx(math.sin(2 * math.pi * 2 / 7))
    with pytest.raises(ValueError):
        clock.cyclical(_ts(stamp), form="lunar")


def test_time_arithmetic(spark):
    got = _one(
        spark,
        minutes=clock.minutes_between(_ts("2024-01-01"), _ts("2023-12-31 23:59:30")),
        days=clock.days_between(_ts("2024-01-01"), _ts("2024-01-02 12:00:00")),
        later=clock.add_minutes(_ts("2024-01-01"), F.lit(1.5)),
        earlier=clock.add_minutes(_ts("2024-01-01"), F.lit(-0.25)),
    )
    assert (got.minutes, got.days) == (-0.5, 1.5)
    assert got.later == dt.datetime(2024, 1, 1, 0, 1, 30) and got.earlier == dt.datetime(2023, 12, 31, 23, 59, 45)


def test_iso_matches_python(spark):
    for text in ("2024-01-01 10:00:00", "2024-01-01 10:00:00.000250", "2024-01-01 10:00:00.5"):
        assert _one(spark, t=clock.iso(_ts(text))).t == pd.Timestamp(text).to_pydatetime().isoformat()


def test_zones(spark):
    got = _one(
        spark,
        wall=clock.strip_zone(F.lit("2025-01-01T10:00:00+02:00")),
        bad=clock.strip_zone(F.lit("soon")),
        local=clock.to_zone(_ts("2024-07-01 02:30:00"), "America/New_York"),
        back=clock.from_zone(F.lit("2024-07-01 02:30:00").cast("timestamp_ntz"), "America/New_York"),
        unread=clock.parse_ts(F.lit("x"), strict=False),
    )
    assert got.wall == dt.datetime(2025, 1, 1, 10) and got.bad is None and got.unread is None
    assert got.local == dt.datetime(2024, 6, 30, 22, 30) and got.back == dt.datetime(2024, 7, 1, 6, 30)
    with pytest.raises(Exception):
        spark.sql("SELECT 'x' AS t").select(clock.parse_ts("t")).collect()


@pytest.mark.parametrize(
    "text,want",
    [("4.5", 4.5), (" 7 ", 7.0), ("-1e3", -1000.0), (".5", 0.5), ("5.", 5.0), ("1.0f", None), ("1d", None), ("", None), ("x", None), ("inf", math.inf)],
)
def test_safe_double(spark, text, want):
    assert _one(spark, v=numbers.safe_double(F.lit(text))).v == want


def test_numbers(spark):
    got = _one(
        spark,
        scaled=numbers.scale(F.lit(7.0), F.lit(5.0), F.lit(4.0)),
        flat=numbers.scale(F.lit(7.0), F.lit(7.0), F.lit(0.0)),
        back=numbers.unscale(F.lit(0.5), F.lit(5.0), F.lit(4.0)),
        small=numbers.huber_loss(F.lit(-0.5)),
        large=numbers.huber_loss(F.lit(3.0)),
        under=numbers.pinball_loss(F.lit(2.0), 0.9),
        over=numbers.pinball_loss(F.lit(-2.0), 0.9),
        text=numbers.metric_text(F.lit(1234.56789)),
        year=numbers.per_year(F.lit(2.0)),
        grid=numbers.grid(F.lit(0.0), F.lit(1.0), 5),
        key=numbers.row_key(F.lit("A"), F.lit("t")),
    )
    assert (got.scaled, got.flat, got.back) == (0.5, None, 7.0)
    assert (got.small, got.large) == (0.125, 2.5)
    assert got.under == pytest.approx(1.8) and got.over == pytest.approx(0.2)
    assert (got.text, got.year, got.key) == ("1234.5679", 730.5, "A#t") and got.grid == [0.0, 0.25, 0.5, 0.75, 1.0]


def test_nan_becomes_null(spark):
    df = spark.createDataFrame([(math.nan,), (1.0,)], "v double")
    assert numbers.nan_to_null(df, ["v"]).where("v >= 0").count() == 1
