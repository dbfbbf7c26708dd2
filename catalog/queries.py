"""Registered queries: each takes (session, folder of the tables)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.inputs import (
    CFG,
    arrivals,
    as_messages,
    cleaned,
    event_stream,
    events,
    featured,
    planted_part,
    raw,
    update_files,
    weather,
)
from gapcast.config import SERIES
from gapcast.functions.clock import (
    add_minutes,
    calendar_parts,
    cyclical,
    days_between,
    iso,
    minute_text,
    parse_ts,
    round_hour,
    strip_zone,
    to_zone,
    weekend_flag,
)
from gapcast.functions.messages import parse_updates
from gapcast.functions.numbers import as_text, metric_text, row_key, safe_double
from gapcast.operators import arrivals as live
from gapcast.operators import clean, columns, fill, forecast, metrics, profile, scaling, slices, spectral, split
from gapcast.operators.asof import asof_join
from gapcast.operators.quantiles import quantiles
from gapcast.operators.rolling import headways, naive_forecast, rolling, rolling_plain
from gapcast.operators.weather import join_monthly_static, join_weather
from gapcast.plans.features import feature_table, written_columns
from gapcast.plans.layout import positions
from gapcast.plans.scratch import new_path, store
from gapcast.plans.training import train_and_evaluate, with_point_forecasts
from gapcast.sources import requests, sinks, tables
from gapcast.sources.polled import read_polled_updates
from gapcast.streaming import late
from gapcast.streaming import live as streaming
from gapcast.streaming.cleaned import live_report, write_cleaned

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}

KEY = (SERIES, "idx")
SCALED = ("duration", "y")
FREQUENCIES = (0.05, 0.05, 200)


def query(function: Query) -> Query:
    """Register under the function's name; times leave without a zone."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        out = function(spark, sf)
        zoned = [c for c, t in out.dtypes if t == "timestamp"]
        return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in zoned}) if zoned else out

    _queries[function.__name__] = run
    return function


def registered() -> dict[str, Query]:
    return dict(_queries)


def _rounded(df: DataFrame, places: int, *names: str) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in names})


# ---- feature table --------------------------------------------------------------


@query
def flagship_features(spark, sf):
    table = feature_table(raw(spark, sf), weather(spark, sf), CFG)
    shown = written_columns(table)
    exact = _rounded(shown, 9, "rolling_mean_10", "rolling_mean_50")
    return _rounded(exact, 6, "rolling_std_10", "rolling_std_50")


# ---- cleaning and columns -------------------------------------------------------


@query
def extract_arrivals(spark, sf):
    arrivals(spark, sf).createOrReplaceTempView("arrivals_source")
    sql = "SELECT series_id, arrival_date, duration, weekday(arrival_date) AS dow FROM arrivals_source"
    return tables.extract(spark, sql)


@query
def clean_arrivals(spark, sf):
    return cleaned(spark, sf).select(SERIES, "idx", "n", "ds", "duration", "y")


@query
def clean_report(spark, sf):
    return clean.clean_report(raw(spark, sf), clean.cleaning_rules(CFG, weather=True))


@query
def clean_report_observed(spark, sf):
    """The report as counted while the cleaned rows are stored."""
    rules = clean.cleaning_rules(CFG, weather=True)
    kept, counts = clean.clean_observed(raw(spark, sf), rules)
    store(kept, "cleaned")
    return clean.observed_report(spark, counts, rules)


@query
def drop_nulls(spark, sf):
    return clean.drop_nulls(raw(spark, sf)).select(SERIES, "arrival_date", "duration", "mbt")


@query
def year_filter(spark, sf):
    rows = arrivals(spark, sf).where(clean.in_years([2024, 2025]))
    return rows.select(SERIES, "arrival_date", "duration")


@query
def date_floor_filter(spark, sf):
    rows = arrivals(spark, sf).where(clean.from_date("2024-01-15"))
    return rows.select(SERIES, "arrival_date", "duration")


@query
def weekend(spark, sf):
    return arrivals(spark, sf).select("tie", weekend_flag("arrival_date").alias("dow"))


@query
def calendar(spark, sf):
    parts = calendar_parts("arrival_date", "America/New_York")
    return arrivals(spark, sf).select("tie", *[c.alias(name) for name, c in parts.items()])


@query
def local_time(spark, sf):
    return arrivals(spark, sf).select("tie", to_zone("arrival_date", "America/New_York").alias("local"))


@query
def parse_times(spark, sf):
    text = F.date_format("arrival_date", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    table = arrivals(spark, sf).select("tie", text.alias("text"), F.concat(text, F.lit("+05:00")).alias("zoned"))
    return table.select("tie", parse_ts("text").alias("parsed"), strip_zone("zoned").alias("wall"))


@query
def default_duration(spark, sf):
    nulled = arrivals(spark, sf).withColumn("duration", F.when(F.col("duration") <= 55, F.col("duration")))
    absent = columns.default_column(nulled.drop("duration").withColumn("source", F.lit("absent")))
    given = columns.default_column(nulled.withColumn("source", F.lit("given")))
    return given.unionByName(absent).select("source", "tie", "duration")


@query
def split_columns(spark, sf):
    table = raw(spark, sf).select("arrival_date", "duration", "mbt", "tie")
    features, target, by_name = columns.split_features_target(columns.require_columns(table, ["mbt"]))
    return table.select(*features, F.col(target).alias("target"), F.lit(by_name).alias("by_name"))


@query
def fill_zero(spark, sf):
    return fill.fill_const(raw(spark, sf), ["mbt"]).select(SERIES, "tie", "mbt")


# ---- time arithmetic and text ---------------------------------------------------


@query
def rounded_hours(spark, sf):
    return arrivals(spark, sf).select("tie", round_hour("arrival_date").alias("hour"))


@query
def time_arithmetic(spark, sf):
    start = F.lit("2024-01-01").cast("timestamp")
    return arrivals(spark, sf).select(
        "tie",
        days_between(start, "arrival_date").alias("days"),
        add_minutes("arrival_date", "duration").alias("later"),
    )


@query
def time_texts(spark, sf):
    return arrivals(spark, sf).select(
        "tie",
        minute_text("arrival_date").alias("label"),
        row_key(F.col(SERIES), iso(F.date_trunc("minute", "arrival_date"))).alias("row_key"),
        metric_text(F.col("duration")).alias("four_places"),
        safe_double(as_text(F.col("duration"))).alias("parsed"),
    )


@query
def cyclical_features(spark, sf):
    angles = cyclical("arrival_date")
    return arrivals(spark, sf).select("tie", *[F.round(c, 7).alias(name) for name, c in angles.items()])


@query
def cyclical_calendar(spark, sf):
    angles = cyclical("arrival_date", form="calendar")
    return arrivals(spark, sf).select("tie", *[F.round(c, 9).alias(name) for name, c in angles.items()])


# ---- weather and fills ----------------------------------------------------------


@query
def weather_join(spark, sf):
    return join_weather(cleaned(spark, sf), weather(spark, sf)).select(
        *KEY, "temp", "precip", "snow", "windspeed"
    )


@query
def weather_asof(spark, sf):
    """The last signup hour that had begun, whatever the gap; a value unknown there comes from the hours before."""
    hours = weather(spark, sf).withColumn("precip", F.when(F.col("snow") > 1, F.col("precip")))
    joined = asof_join(cleaned(spark, sf).select(*KEY, "ds"), hours, "ds", "datetime", ["temp", "precip"])
    return joined.select(*KEY, "temp", "precip")


@query
def last_value_by_user(spark, sf):
    """Each arrival with its user's last value before it, by an as-of join per user."""
    rows = events(spark, sf).select("event_id", "user_id", F.col("ts").alias("at"))
    known = events(spark, sf).where("event_type <> 'view'").select("user_id", F.col("ts").alias("seen"), "value")
    return asof_join(rows, known, "at", "seen", ["value"], ["user_id"]).select("event_id", "value")


@query
def weather_from_file(spark, sf):
    """The weather read from a CSV file of whichever columns it has, helpers dropped after the join."""
    path = new_path(spark, "weather-csv")
    sinks.write_table(weather(spark, sf).drop("windspeed"), path, "csv")
    rows = cleaned(spark, sf).withColumn("datetime", F.col("ds"))
    joined = columns.drop_helpers(join_weather(rows, tables.read_weather(spark, path)))
    return joined.select(*[c for c in joined.columns if c in (*KEY, "datetime", "temp", "precip", "snow", "windspeed")])


@query
def weather_join_forward_only(spark, sf):
    joined = join_weather(cleaned(spark, sf), weather(spark, sf), back=False)
    return joined.select(*KEY, "temp", "precip", "snow", "windspeed")


def _gappy(spark, sf):
    """Cleaned arrivals whose duration is unknown above 20 minutes."""
    rows = clean.clean(raw(spark, sf), clean.cleaning_rules(CFG))
    return rows.withColumn("known", F.when(F.col("duration") <= 20, F.col("duration")))


@query
def forward_fill(spark, sf):
    return fill.forward_fill(_gappy(spark, sf), ["known"], order="gid").select(SERIES, "tie", "known")


@query
def backward_fill(spark, sf):
    return fill.backward_fill(_gappy(spark, sf), ["known"], order="gid").select(SERIES, "tie", "known")


@query
def rolling_back_filled_with_gaps(spark, sf):
    numbered = positions(_gappy(spark, sf).drop("gid", "chunk"), ["arrival_date", "tie"])
    features = [("rolling_mean_3", "mean", 3), ("rolling_max_3", "max", 3)]
    out = rolling(numbered, "known", features, dense=False, block_rows=CFG.block_rows)
    return _rounded(out.select(*KEY, "rolling_mean_3", "rolling_max_3"), 9, "rolling_mean_3")


@query
def monthly_static(spark, sf):
    causes = events(spark, sf).where("event_type = 'error'")
    monthly = causes.groupBy(F.date_format("ts", "yyyy-MM").alias("month_id")).agg(
        F.count(F.lit(1)).alias("cause_count")
    )
    return join_monthly_static(cleaned(spark, sf), monthly).select(*KEY, "month_id", "cause_count")


# ---- row windows ----------------------------------------------------------------


def _rolling_one(name, fn, width):
    def run(spark, sf):
        out = rolling(cleaned(spark, sf), "y", [(name, fn, width)], dense=True, block_rows=CFG.block_rows)
        return out.select(*KEY, F.round(name, 6 if fn == "std" else 9).alias(name))

    run.__name__ = name
    return query(run)


for _name, _fn, _width in (
    ("rolling_mean_10", "mean", 10),
    ("rolling_mean_50", "mean", 50),
    ("rolling_std_10", "std", 10),
    ("rolling_std_50", "std", 50),
    ("rolling_max_10", "max", 10),
):
    _rolling_one(_name, _fn, _width)


@query
def rolling_plain_50(spark, sf):
    out = rolling_plain(cleaned(spark, sf), block_rows=CFG.block_rows)
    return out.select(*KEY, F.round("rolling_mean_50", 9).alias("rolling_mean_50"))


@query
def headways_last_150(spark, sf):
    source = arrivals(spark, sf).withColumnRenamed("arrival_date", "ds")
    return headways(source, order=("ds", "tie")).select(SERIES, "ds", "y")


@query
def headways_all(spark, sf):
    source = arrivals(spark, sf).withColumnRenamed("arrival_date", "ds")
    return headways(source, last_n=None, order=("ds", "tie")).select(SERIES, "idx", "n", "ds", "y")


@query
def naive(spark, sf):
    return naive_forecast(cleaned(spark, sf), block_rows=CFG.block_rows).select(*KEY, "y", "naive")


@query
def split_60_20_20(spark, sf):
    return split.split(cleaned(spark, sf)).select(*KEY, "split")


@query
def split_50_25_25(spark, sf):
    return split.split(cleaned(spark, sf), 0.5, 0.25).select(*KEY, "split")


@query
def history_future_split(spark, sf):
    return split.history_future_split(cleaned(spark, sf), 3).select(*KEY, "part")


@query
def pad_history(spark, sf):
    padded = split.pad_history(cleaned(spark, sf), 160)
    return padded.select(SERIES, "step", "is_pad", "ds", "y")


@query
def pad_short_history(spark, sf):
    by_user = events(spark, sf).select("user_id", "event_id", "value")
    numbered = positions(by_user, ["event_id"], by=["user_id"])
    return split.pad_history(numbered, 100).select("user_id", "step", "is_pad", "value")


@query
def append_future_row(spark, sf):
    longer = split.append_future_row(cleaned(spark, sf).select(*KEY, "n", "ds", "y"))
    featured_rows = join_weather(longer, weather(spark, sf)).withColumn("dow", weekend_flag("ds"))
    return featured_rows.select(*KEY, "ds", "y", "is_future", "temp", "dow")


@query
def align_future(spark, sf):
    parts = split.history_future_split(cleaned(spark, sf), 2)
    history, future = parts.where("part = 'history'"), parts.where("part = 'future'")
    return split.align_future(history, future, horizon=2).select(*KEY, "ds", "step", "aligned")


# ---- slices ---------------------------------------------------------------------


@query
def tail_200(spark, sf):
    return slices.tail(cleaned(spark, sf)).select(*KEY, "ds", "y")


@query
def head_165(spark, sf):
    return slices.head(cleaned(spark, sf)).select(*KEY, "ds", "y")


@query
def latest_100(spark, sf):
    return slices.latest(arrivals(spark, sf), 100, ["arrival_date", "tie"]).select(SERIES, "tie", "arrival_date")


@query
def slice_175(spark, sf):
    return slices.positional_slice(cleaned(spark, sf)).select(*KEY, "y")


@query
def slice_ticks(spark, sf):
    return slices.slice_ticks(cleaned(spark, sf)).select(*KEY, "tick", "label")


@query
def sorted_series(spark, sf):
    return slices.sort_series(cleaned(spark, sf), ["ds", "tie"]).select(*KEY, "ds")


# ---- profile --------------------------------------------------------------------


@query
def quantiles_11(spark, sf):
    return _rounded(quantiles(cleaned(spark, sf), "y"), 9, "quantile")


@query
def quantiles_11_duration(spark, sf):
    return _rounded(quantiles(arrivals(spark, sf), "duration"), 9, "quantile")


@query
def describe(spark, sf):
    table = profile.describe(cleaned(spark, sf), ["duration", "y"])
    return _rounded(table, 6, "mean", "std", "q25", "q50", "q75")


@query
def hourly_means(spark, sf):
    return _rounded(profile.hourly_means(cleaned(spark, sf), tz="America/New_York"), 6, "mean")


@query
def heatmap(spark, sf):
    table = profile.present_days(profile.heatmap(cleaned(spark, sf)))
    return _rounded(table, 6, *[c for c in table.columns if c != "hour"])


def _histogram(bins):
    def run(spark, sf):
        table = profile.histogram(cleaned(spark, sf), "y", bins)
        return _rounded(table, 9, "lower", "upper")

    run.__name__ = f"histogram_{bins}"
    return query(run)


for _bins in (10, 30, 50):
    _histogram(_bins)


@query
def histogram_density(spark, sf):
    table = profile.histogram(cleaned(spark, sf), "duration", 30, density=True)
    return _rounded(table, 9, "lower", "upper", "density")


@query
def kde_200(spark, sf):
    rows = naive_forecast(cleaned(spark, sf), block_rows=CFG.block_rows)
    return _rounded(profile.kde(rows, ["y", "naive"]), 9, "x", "density")


@query
def kde_residuals(spark, sf):
    rows = naive_forecast(cleaned(spark, sf), block_rows=CFG.block_rows)
    errors = rows.withColumn("error", F.col("y") - F.col("naive"))
    return _rounded(profile.kde(errors, ["error"], bins=30), 6, "x", "density", "curve")


@query
def row_count(spark, sf):
    return profile.row_count(events(spark, sf), ["event_type"])


@query
def frame_shape(spark, sf):
    return profile.frame_shape(events(spark, sf))


# ---- spectrum -------------------------------------------------------------------


@query
def periodogram(spark, sf):
    return _rounded(spectral.periodogram(cleaned(spark, sf), FREQUENCIES), 6, "frequency", "power")


@query
def autopower(spark, sf):
    return _rounded(spectral.autopower(cleaned(spark, sf)), 6, "frequency", "power")


@query
def spectral_peaks(spark, sf):
    found = spectral.peaks(spectral.autopower(cleaned(spark, sf)))
    return _rounded(found, 6, "frequency", "power", "per_year", "period_days")


# ---- scaling and windows --------------------------------------------------------


@query
def scaler(spark, sf):
    return _rounded(scaling.fit_scaler(split.split(cleaned(spark, sf)), SCALED), 6, "mean", "std")


@query
def scaler_reloaded(spark, sf):
    """Rows scaled by a scaler that was written and read again."""
    rows, path = split.split(cleaned(spark, sf)), new_path(spark, "scaler")
    sinks.write_scaler(scaling.fit_scaler(rows, SCALED), path)
    scaled = scaling.apply_scaler(rows, tables.load_scaler(spark, path), SCALED)
    return _rounded(scaled.select(*KEY, *SCALED), 6, *SCALED)


@query
def standard_scale(spark, sf):
    rows = split.split(cleaned(spark, sf))
    scaled = scaling.apply_scaler(rows, scaling.fit_scaler(rows, SCALED), SCALED)
    return _rounded(scaled.select(*KEY, *SCALED), 6, *SCALED)


@query
def inverse_scale(spark, sf):
    rows = split.split(cleaned(spark, sf))
    fitted = store(scaling.fit_scaler(rows, SCALED), "fitted")
    back = scaling.inverse_scale(scaling.apply_scaler(rows, fitted, SCALED), fitted, SCALED)
    return _rounded(back.select(*KEY, *SCALED), 9, *SCALED)


@query
def robust_scale(spark, sf):
    rows = split.split(cleaned(spark, sf))
    scaled = scaling.apply_scaler(rows, scaling.fit_robust_scaler(rows, SCALED), SCALED)
    return _rounded(scaled.select(*KEY, *SCALED), 6, *SCALED)


def _windows(spark, sf, **options):
    return split.make_windows(cleaned(spark, sf), SCALED, length=24, block_rows=CFG.block_rows, **options)


@query
def make_windows(spark, sf):
    head = (SERIES, "split", "start_idx", "target_idx", "target_ds", "target")
    return _windows(spark, sf).select(*head, F.posexplode("features").alias("step", "_f")).select(
        *head, "step", "_f.*"
    )


@query
def test_windows_reloaded(spark, sf):
    path = new_path(spark, "windows")
    built = _windows(spark, sf)
    sinks.write_windows(built, path)
    windows = tables.load_windows(spark, path, schema=built.schema)
    return windows.select(SERIES, "split", "start_idx", "target", F.col("features")[0]["y"].alias("first_y"))


@query
def shuffled_batches(spark, sf):
    places = split.shuffle_batches(_windows(spark, sf, splits=("train",)).drop("features"), seed=7)
    return places.groupBy("batch").agg(
        F.count(F.lit(1)).alias("rows"), F.min("place").alias("first"), F.max("place").alias("last")
    )


@query
def shuffled_members(spark, sf):
    places = split.shuffle_batches(_windows(spark, sf, splits=("train",)).drop("features"), seed=7)
    return places.select(SERIES, "start_idx", "target")


@query
def shuffle_order(spark, sf):
    """Places are a permutation, and not the order of the series."""
    rows = _windows(spark, sf, splits=("train",)).drop("features")
    shuffled = split.shuffle_batches(rows, seed=7).select(SERIES, "start_idx", "place")
    plain = split.ordered_batches(rows).select(SERIES, "start_idx", F.col("place").alias("plain"))
    moved = F.avg((F.col("place") != F.col("plain")).cast("int")) > 0.5
    return shuffled.join(plain, [SERIES, "start_idx"]).agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct("place").alias("places"),
        F.coalesce(F.min("place"), F.lit(0)).alias("first"), F.coalesce(F.max("place"), F.lit(-1)).alias("last"),
        F.coalesce(moved, F.lit(True)).alias("moved"),
    )


@query
def ordered_batches(spark, sf):
    places = split.ordered_batches(_windows(spark, sf, splits=("val", "test")).drop("features"))
    return places.select(SERIES, "start_idx", "place", "batch")


@query
def forecast_context(spark, sf):
    rows = split.split(cleaned(spark, sf))
    fitted = store(scaling.fit_scaler(rows, SCALED), "fitted")
    scaled = scaling.apply_scaler(rows.withColumn("raw_y", F.col("y")), fitted, SCALED)
    windows = split.make_windows(scaled, [*SCALED, "raw_y"], "raw_y", 24, block_rows=CFG.block_rows)
    windows = windows.withColumn("last_seen", F.element_at("features", -1)["raw_y"])
    shown = metrics.forecast_context(store(windows, "windows"), fitted, "last_seen")
    long = shown.select(
        SERIES, "sample", "true_value", "prediction", "abs_error", F.posexplode("history").alias("step", "history")
    )
    return _rounded(long, 9, "history")


# ---- evaluation -----------------------------------------------------------------


def _forecast(spark, sf):
    """Naive forecast and a moving mean over the last share, with cutoffs."""
    rows = rolling(cleaned(spark, sf), "y", [("mean_10", "mean", 10)], fill=False, dense=True, block_rows=CFG.block_rows)
    from gapcast.plans.layout import shifted

    lagged = shifted(rows, {"naive": ("y", 1), "moving": ("mean_10", 1)}, block_rows=CFG.block_rows)
    return split.rolling_origin(lagged, block_rows=CFG.block_rows)


@query
def rolling_origin_cv(spark, sf):
    return _forecast(spark, sf).select(*KEY, "cutoff", "ds", "ahead", "y", "naive")


@query
def rolling_origin_three_ahead(spark, sf):
    rows = split.rolling_origin(cleaned(spark, sf), horizon=3, step=2, block_rows=CFG.block_rows)
    return rows.select(*KEY, "cutoff", "cutoff_idx", "ahead", "ds", "y")


def _metric(name, metric):
    def run(spark, sf):
        rows = _forecast(spark, sf)
        return rows.groupBy(SERIES).agg(F.round(metric(F.col("y"), F.col("naive")), 6).alias(name))

    run.__name__ = name
    return query(run)


for _name, _fn in (
    ("mae", metrics.mae),
    ("rmse", metrics.rmse),
    ("huber", metrics.huber(1.0)),
    ("pinball_10", metrics.pinball(0.1)),
    ("pinball_50", metrics.pinball(0.5)),
    ("pinball_90", metrics.pinball(0.9)),
):
    _metric(_name, _fn)


@query
def evaluate(spark, sf):
    return _rounded(metrics.evaluate(_forecast(spark, sf), ["naive", "moving"]), 6, "value")


@query
def compare_models(spark, sf):
    return _rounded(metrics.compare_models(_forecast(spark, sf), ["naive", "moving"]), 6, "mae", "rmse")


@query
def metrics_json(spark, sf):
    scores = _rounded(metrics.evaluate(_forecast(spark, sf), ["naive"]), 6, "value")
    path = new_path(spark, "metrics")
    sinks.write_metrics(metrics.metrics_document(scores), path)
    item = "array<struct<name:string,numberValue:double,format:string>>"
    read = spark.read.schema(f"{SERIES} string, model string, metrics {item}").json(path)
    return read.select(SERIES, "model", F.inline("metrics"))


@query
def residual_frame(spark, sf):
    return metrics.residual_frame(_forecast(spark, sf), predicted="naive").select(
        *KEY, "Actual", "Predicted", "Error", "Abs Error"
    )


@query
def naive_mae(spark, sf):
    return _rounded(metrics.naive_mae(cleaned(spark, sf), 24, block_rows=CFG.block_rows), 6, "mae")


@query
def target_dates(spark, sf):
    rows = cleaned(spark, sf)
    predictions = split.make_windows(rows, ["y"], length=24, splits=("test",), block_rows=CFG.block_rows)
    dated = metrics.attach_target_dates(predictions.drop("features"), rows)
    return dated.select(SERIES, "target_idx", "target_ds", "target")


# ---- models ---------------------------------------------------------------------


def _seasonal(spark, sf):
    rows = split.split(cleaned(spark, sf))
    model = forecast.fit_seasonal_quantiles(rows.where("split = 'train'"))
    return forecast.seasonal_quantile_forecast(rows.where("split = 'test'"), model)


@query
def seasonal_quantile_forecast(spark, sf):
    return _rounded(_seasonal(spark, sf).select(*KEY, "lo80", "yhat", "hi80"), 6, "lo80", "yhat", "hi80")


@query
def coverage(spark, sf):
    return _rounded(metrics.coverage(_seasonal(spark, sf)), 6, "coverage", "mean_width")


@query
def residual_band(spark, sf):
    rows = split.split(naive_forecast(cleaned(spark, sf), block_rows=CFG.block_rows))
    val, test = rows.where("split = 'val'"), rows.where("split = 'test'")
    banded = forecast.residual_band(test, val, "naive")
    return _rounded(banded.select(*KEY, "lo80", "hi80"), 6, "lo80", "hi80")


@query
def best_by_validation(spark, sf):
    rows = rolling(cleaned(spark, sf), "y", [("mean_10", "mean", 10)], fill=False, dense=True, block_rows=CFG.block_rows)
    from gapcast.plans.layout import shifted

    lagged = split.split(shifted(rows, {"naive": ("y", 1), "moving": ("mean_10", 1)}, block_rows=CFG.block_rows))
    return _rounded(forecast.best_by_validation(lagged, ["naive", "moving"]), 6, "loss")


@query
def huber_regression(spark, sf):
    scored = with_point_forecasts(store(featured(spark, sf, False), "features"), CFG, lags=12)
    return _rounded(scored.where("split = 'test'").select(*KEY, "y", "huber"), 5, "huber")


@query
def training_run(spark, sf):
    run = train_and_evaluate(store(featured(spark, sf, False), "features"), CFG, lags=12)
    return _rounded(run.scores, 6, "value")


# ---- files ----------------------------------------------------------------------


@query
def csv_reloaded(spark, sf):
    path = new_path(spark, "arrivals-csv")
    table = raw(spark, sf).withColumn("dow", weekend_flag("arrival_date"))
    sinks.write_table(table.select("arrival_date", "duration", "mbt", "dow", "tie"), path, "csv")
    read = tables.read_arrivals_csv(spark, path)
    return read.select(F.col("tie").cast("long").alias("tie"), "arrival_date", "duration", "mbt", "dow")


@query
def positional_reloaded(spark, sf):
    path = new_path(spark, "features-csv")
    table = cleaned(spark, sf).select("ds", "duration", "y", "tie")
    sinks.write_table(table, path, "csv")
    numbers, target = tables.read_positional(spark, path)
    return numbers.select("tie", "duration", F.col(target).alias("target"))


def _documents(spark, sf):
    return events(spark, sf).select(
        "event_id",
        F.concat_ws("#", "event_type", F.col("event_id").cast("string")).alias("doc_id"),
        F.date_format("ts", "yyyy-MM-dd HH").alias("timestamp_str"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        F.col("event_type").alias("route_id"),
        F.col("user_id").cast("string").alias("stop_id"),
        F.col("value").alias("predicted_mbt"),
        F.lit("ok").alias("status"),
        F.col("ts").cast("timestamp").alias("created_at"),
    )


@query
def stored_predictions(spark, sf):
    path = new_path(spark, "predictions")
    sinks.write_predictions(_documents(spark, sf).drop("event_id"), path)
    return tables.read_predictions(spark, path, limit=100, versions=True)


@query
def prediction_store(spark, sf):
    """Two writers, one of whose batches runs twice; the reader sees each key once."""
    path = new_path(spark, "prediction-store")
    documents = _documents(spark, sf).withColumn("created_at", F.col("created_at") + F.expr("INTERVAL 1 HOUR"))
    for _ in range(2):
        sinks.replace_batch(documents.where("event_id % 2 = 0").drop("event_id"), path, "even", 3)
    sinks.write_predictions(documents.where("event_id % 3 = 0").drop("event_id").withColumn("predicted_mbt", F.lit(-1.0)), path)
    return tables.read_predictions(spark, path)


@query
def latest_predictions(spark, sf):
    newest = live.latest_per_key(_documents(spark, sf).drop("event_id"))
    return newest.select("route_id", "timestamp_str", "doc_id", "predicted_mbt")


# ---- messages and requests ------------------------------------------------------


@query
def parse_messages(spark, sf):
    return parse_updates(as_messages(events(spark, sf)))


@query
def parse_messages_for_targets(spark, sf):
    wanted = events(spark, sf).where("event_type = 'error'").select(F.col("user_id").cast("string").alias("target"))
    return parse_updates(as_messages(events(spark, sf)), targets=wanted).select("target", "timestamp", "eta")


@query
def station_filter(spark, sf):
    rows = events(spark, sf).select(
        "event_id",
        F.when(F.col("event_id") % 2 == 0, F.col("event_type")).alias("device_id"),
        F.when(F.col("event_id") % 2 == 1, F.col("event_type")).alias("station_id"),
    )
    return clean.station_filter(rows, ["view", "purchase"])


@query
def detect_arrivals(spark, sf):
    updates = events(spark, sf).select(
        F.col("user_id").cast("string").alias(SERIES),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("value").alias("eta"),
        "event_id",
    )
    return live.detect_arrivals(updates, ["ts", "event_id"]).select(SERIES, "event_id", "ts", "eta", "arrival")


@query
def trip_durations(spark, sf):
    stops = events(spark, sf).select(
        "user_id",
        F.to_date("ts").cast("string").alias("day"),
        F.col("event_type").alias("stop"),
        F.col("ts").cast("timestamp").alias("ts"),
    )
    return live.trip_durations(stops, ["user_id", "day"], "stop", "ts", "view", "purchase")


@query
def eta_forecast(spark, sf):
    rows = cleaned(spark, sf)
    next_headway = slices.tail(rows, 1).select(SERIES, F.col("y").alias("yhat"))
    poll = F.lit("2024-01-31").cast("timestamp")
    shown = live.eta_forecast(next_headway, rows, poll)
    return shown.select(SERIES, "last_arrival", "predicted_headway", "predicted_arrival", "minutes_remaining")


@query
def prediction_cells(spark, sf):
    rows = cleaned(spark, sf)
    next_headway = slices.tail(rows, 1).select(SERIES, F.lit(7.5).alias("yhat"))
    shown = live.eta_forecast(next_headway, rows, F.lit("2024-01-31").cast("timestamp"))
    cells = live.prediction_cells(shown)
    return cells.select("row_key", "predicted_headway", "predicted_arrival_time", "last_arrival_time")


@query
def staleness(spark, sf):
    updates = events(spark, sf).select(F.col("user_id"), F.col("ts").cast("timestamp").alias("ts"))
    return live.staleness(updates, F.lit("2024-01-31").cast("timestamp"), by=["user_id"])


def _decoded(spark, sf):
    built = requests.build_requests(cleaned(spark, sf), columns=["ds", "duration", "y"])
    return requests.decode_requests(built, key=[SERIES])


@query
def requests_round_trip(spark, sf):
    rows, _ = _decoded(spark, sf)
    return rows.select(SERIES, "idx", "n", "unique_id", "ds", "duration", "y")


@query
def request_errors(spark, sf):
    texts = events(spark, sf).select(F.col("event_id").alias("request_id"), F.col("props").alias("payload"))
    _, errors = requests.decode_requests(texts)
    return errors


@query
def short_requests(spark, sf):
    return clean.reject_short(events(spark, sf), 60, ["user_id"])


@query
def responses(spark, sf):
    last = slices.tail(cleaned(spark, sf), 2).select(SERIES, "idx", "y")
    shape = "predictions array<struct<idx:bigint,y:double>>"
    answered = requests.encode_response(last, [SERIES], ["idx"])
    return answered.select(SERIES, F.inline(F.from_json("response", shape)["predictions"]))


# ---- streams --------------------------------------------------------------------


def _updates(spark, sf, **options):
    path, files = update_files(spark, sf, **options)
    return streaming.parse_stream(tables.read_vehicle_updates(spark, path, files_per_batch=files))


@query
def stream_updates(spark, sf):
    return streaming.run_available(_updates(spark, sf), "updates")


@query
def stream_polled_updates(spark, sf):
    """The same from a polled feed, in two runs that share a checkpoint."""
    feed, path, checkpoint = (new_path(spark, name, owned=name != "poll-checkpoint") for name in ("feed", "polled", "poll-checkpoint"))
    for half in range(2):
        as_messages(events(spark, sf).where(F.col("event_id") % 2 == half)).write.mode("append").text(feed)
        updates = streaming.parse_stream(read_polled_updates(spark, feed))
        run = updates.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        run.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(path)


@query
def stream_snapshots(spark, sf):
    return streaming.run_available(streaming.tumbling_snapshots(_updates(spark, sf)), "snapshots")


@query
def stream_clean_report(spark, sf):
    """What the rules removed from a stream of arrivals, over several micro-batches."""
    table = raw(spark, sf).select(SERIES, "arrival_date", "duration", "mbt")
    arrived, path = new_path(spark, "arrived"), new_path(spark, "cleaned")
    table.repartition(4, "arrival_date").write.parquet(arrived)
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(arrived)
    rules = clean.cleaning_rules(CFG, weather=True)
    run = write_cleaned(stream, rules, path, new_path(spark, "cleaned-checkpoint", owned=False), availableNow=True)
    run.awaitTermination()
    return live_report(spark, path)


@query
def stream_late_rows(spark, sf):
    """Rows of a planted disorder that come after the watermark has passed them, with that watermark."""
    updates = _updates(spark, sf, disorder=planted_part)
    path = new_path(spark, "late")
    late.split_late(updates, path, new_path(spark, "late-checkpoint", owned=False), availableNow=True).awaitTermination()
    return late.late_rows(spark, path).select(SERIES, "ts", "eta", "batch", "watermark")


@query
def stream_late_counts(spark, sf):
    updates = _updates(spark, sf, disorder=planted_part)
    path = new_path(spark, "late-counts")
    run = late.split_late(updates, path, new_path(spark, "late-checkpoint", owned=False), behind=1, availableNow=True)
    run.awaitTermination()
    return late.late_counts(spark, path)


@query
def stream_arrivals(spark, sf):
    return streaming.run_available(streaming.detect_arrivals_stream(_updates(spark, sf)), "arrivals")


@query
def stream_headways(spark, sf):
    return streaming.run_available(streaming.stream_headways(_updates(spark, sf)), "headways")


@query
def stream_features(spark, sf):
    features = streaming.stream_features(_updates(spark, sf), history=60)
    out = streaming.run_available(streaming.with_future_row(features, weather(spark, sf)), "features")
    shown = out.withColumn("oldest", F.col("history")[0]).drop("history", "snow", "windspeed", "precip")
    exact = _rounded(shown, 9, "rolling_mean_10", "rolling_mean_50")
    return _rounded(exact, 5, "rolling_std_50", "rolling_std_10")


@query
def stream_predictions(spark, sf):
    features = streaming.stream_features(_updates(spark, sf), history=60)

    def last_value():
        return lambda batch: batch["y"]

    poll = F.col("ds") + F.expr("INTERVAL 90 SECONDS")
    forecasts = streaming.score_stream(features, last_value, ["y"], poll_time=poll).withColumn("route", F.lit("L"))
    path = new_path(spark, "documents")
    query = sinks.write_predictions(
        sinks.prediction_documents(forecasts, "route", SERIES), path, new_path(spark, "documents-checkpoint", owned=False), availableNow=True
    )
    query.awaitTermination()
    return tables.stored_documents(spark, path).drop("created_at")


@query
def stream_minutes_remaining(spark, sf):
    """What is left of the forecast headway 90 seconds after the arrival."""
    features = streaming.stream_features(_updates(spark, sf), history=60)
    poll = F.col("ds") + F.expr("INTERVAL 90 SECONDS")
    forecasts = streaming.score_stream(features, lambda: lambda batch: batch["y"], ["y"], poll_time=poll)
    return streaming.run_available(forecasts.select(SERIES, "ds", "yhat", "minutes_remaining"), "remaining")


@query
def stream_trip_durations(spark, sf):
    stops = event_stream(spark, sf).select(
        F.floor(F.col("event_id") / 2).alias("trip_id"),
        (F.col("event_id") % 2 == 0).alias("at_origin"),
        F.col("ts").cast("timestamp").alias("ts"),
    )
    trips = streaming.trip_durations_stream(stops.where("at_origin"), stops.where("NOT at_origin"))
    return streaming.run_available(trips, "trips")
