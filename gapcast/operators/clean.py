"""Row filters and the report on what they remove."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from gapcast.config import SERIES, Config


def _holds(rule: Column) -> Column:
    return F.coalesce(rule, F.lit(False))


def cleaning_rules(cfg: Config = Config(), weather: bool = False) -> dict[str, Column]:
    """The filters in the order they apply. Null and NaN fail the first one that names their column."""
    rules = {
        "duration_min": (F.col("duration") >= cfg.min_duration) & (F.col("duration") < float("inf")),
        "duration_max": F.col("duration") <= cfg.max_duration,
        "headway_max": F.col("mbt") <= cfg.max_headway,
    }
    if weather and cfg.weather_from:
        rules["weather_range"] = from_date(cfg.weather_from)
    return rules


def from_date(start: str, column: str = "arrival_date") -> Column:
    return F.col(column) >= F.lit(start).cast("timestamp")


def in_years(years: Sequence[int], column: str = "arrival_date") -> Column:
    """Rows of the given years, as one pushable time range per run of years."""
    runs: list[list[int]] = []
    for year in sorted(set(years)):
        if runs and year == runs[-1][1] + 1:
            runs[-1][1] = year
        else:
            runs.append([year, year])
    keep = F.lit(False)
    for first, last in runs:
        start = F.lit(f"{first}-01-01").cast("timestamp")
        end = F.lit(f"{last + 1}-01-01").cast("timestamp")
        keep = keep | ((F.col(column) >= start) & (F.col(column) < end))
    return keep


def clean(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    for rule in rules.values():
        df = df.where(rule)
    return df


def _rule_counts(rules: dict[str, Column]) -> list[Column]:
    """Rows in all (``_0``) and rows that pass the first rule, the first two, and so on."""
    passed, counts = F.lit(True), [F.count(F.lit(1)).alias("_0")]
    for at, rule in enumerate(rules.values(), 1):
        passed = passed & _holds(rule)
        counts.append(F.count_if(passed).alias(f"_{at}"))
    return counts


def _report_rows(counts: DataFrame, rules: dict[str, Column]) -> DataFrame:
    steps = F.array(
        *[
            F.struct(
                F.lit(at).alias("step"),
                F.lit(name).alias("rule"),
                F.col(f"_{at - 1}").alias("rows_before"),
                F.col(f"_{at}").alias("rows_after"),
                (F.col(f"_{at - 1}") - F.col(f"_{at}")).alias("removed"),
            )
            for at, name in enumerate(rules, 1)
        ]
    )
    return counts.select(F.inline(steps))


def clean_report(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """step, rule, rows_before, rows_after, removed per rule, from one pass over the rows."""
    return _report_rows(df.agg(*_rule_counts(rules)), rules)


def clean_observed(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, Observation]:
    """The cleaned rows, and an observation that counts for the report while they are computed.

    ``observed_report`` reads it after the first action over the rows, without another pass.
    """
    counts = Observation()
    return clean(df.observe(counts, *_rule_counts(rules)), rules), counts


def observed_report(spark: SparkSession, counts: Observation, rules: dict[str, Column]) -> DataFrame:
    """The rows of ``clean_report``; waits for the action that the observation is in."""
    known = counts.get
    names = [f"_{at}" for at in range(len(rules) + 1)]
    row = spark.createDataFrame([tuple(known[c] for c in names)], ", ".join(f"{c} bigint" for c in names))
    return _report_rows(row, rules)


def drop_nulls(df: DataFrame, subset: list[str] | None = None) -> DataFrame:
    return df.dropna(subset=subset)


def station_filter(df: DataFrame, targets: list[str] | DataFrame) -> DataFrame:
    """Rows naming a target in ``device_id`` or ``station_id``."""
    if isinstance(targets, list):
        return df.where(F.col("device_id").isin(*targets) | F.col("station_id").isin(*targets))
    wanted = targets.select(F.col("target")).distinct()
    by_device = df.join(wanted, df["device_id"] == wanted["target"], "left_semi")
    others = df.join(wanted, df["device_id"] == wanted["target"], "left_anti")
    return by_device.unionByName(others.join(wanted, others["station_id"] == wanted["target"], "left_semi"))


def reject_short(df: DataFrame, horizon: int = 1, by: Sequence[str] = (SERIES,)) -> DataFrame:
    """One row per request that is not longer than the horizon, with an error text."""
    counts = df.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"))
    text = F.format_string(
        f"%d rows are too few: a forecast of {horizon} needs more rows than that",
        F.col("rows"),
    )
    return counts.where(F.col("rows") <= horizon).withColumn("error", text)
