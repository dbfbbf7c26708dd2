"""Every tunable of the engine, with its default."""

from __future__ import annotations

from dataclasses import dataclass

# Column names and constants the results depend on.
WEATHER_COLUMNS = ("temp", "precip", "snow", "snowdepth", "visibility", "windspeed")
REQUIRED_COLUMNS = ("arrival_date", "duration", "mbt", "dow")
ROLLING_FEATURES = (
    ("rolling_std_50", "std", 50),
    ("rolling_max_10", "max", 10),
    ("rolling_mean_10", "mean", 10),
    ("rolling_std_10", "std", 10),
    ("rolling_mean_50", "mean", 50),
)
FUTURE_KNOWN = WEATHER_COLUMNS + ("dow",)
HISTORY_ONLY = (
    "rolling_mean_10",
    "rolling_std_10",
    "rolling_mean_50",
    "rolling_std_50",
    "rolling_max_10",
    "duration",
)
QUANTILE_LEVELS = (0.0, 0.001, 0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99, 0.999, 1.0)
FORECAST_LEVELS = (0.1, 0.5, 0.9)
DAY_NAMES = (
    "Monday",
    "Tuesday",
    "Wednesday",
    "Thursday",
    "Friday",
    "Saturday",
    "Sunday",
)

SERIES = "series_id"


@dataclass(frozen=True)
class Config:
    min_duration: float = 0.0
    max_duration: float = 55.0
    max_headway: float = 35.0
    weather_from: str | None = "2024-01-01"
    weather_tz: str = "UTC"
    lookback: int = 160
    horizon: int = 1
    train_share: float = 0.6
    val_share: float = 0.2
    test_share: float = 0.2
    batch_size: int = 256
    history_steps: int = 150
    min_gap: float = 1.0
    eta_jump: float = 3.0
    request_rows: int = 165
    report_rows: int = 200
    frequency: str = "1 hour"
    # Rows a task handles as one positional block (see plans/layout.py).
    block_rows: int = 8192
