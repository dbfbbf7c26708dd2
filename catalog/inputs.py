"""The given tables as arrivals, weather, messages and streams."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gapcast.config import SERIES, Config
from gapcast.operators.rolling import with_headway
from gapcast.plans.features import add_features, clean_arrivals
from gapcast.plans.layout import lay_out
from gapcast.plans.scratch import new_path

# Small blocks, so that the given tables span several.
CFG = Config(block_rows=512, lookback=24)
#: Messages that one task sorts and writes, some 60 MB.
FILE_ROWS = 250_000


def events(spark: SparkSession, sf: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf}/events.parquet")


def arrivals(spark: SparkSession, sf: str) -> DataFrame:
    """One series per event type; the value stands for the trip duration."""
    return events(spark, sf).select(
        F.col("event_type").alias(SERIES),
        F.col("ts").cast("timestamp").alias("arrival_date"),
        F.col("event_id").alias("tie"),
        F.col("value").alias("duration"),
    )


def raw(spark: SparkSession, sf: str) -> DataFrame:
    """Arrivals in order, with the minutes since the arrival before."""
    laid = lay_out(arrivals(spark, sf), ["arrival_date", "tie"], name="arrivals")
    return with_headway(laid, "arrival_date")


def cleaned(spark: SparkSession, sf: str) -> DataFrame:
    return clean_arrivals(raw(spark, sf), CFG).drop("chunk")


def weather(spark: SparkSession, sf: str) -> DataFrame:
    """Hours with a signup, as an hourly weather table with gaps."""
    signups = events(spark, sf).where("event_type = 'signup'")
    return signups.groupBy(F.date_trunc("hour", "ts").alias("datetime")).agg(
        F.max("value").alias("temp"),
        F.min("value").alias("precip"),
        F.count("value").cast("double").alias("snow"),
        (F.max("value") - F.min("value")).alias("windspeed"),
    )


def featured(spark: SparkSession, sf: str, with_weather: bool = True) -> DataFrame:
    return add_features(cleaned(spark, sf), weather(spark, sf) if with_weather else None, CFG, dense=True)


def message() -> Column:
    """An event as a JSON message in one of four shapes."""
    device = F.col("user_id").cast("string")
    time = F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("timestamp")
    eta = F.col("value").alias("minutes_until_arrival")
    by_device = F.struct(device.alias("device_id"), time, eta)
    keyed = F.struct(time, F.col("value").cast("string").alias("minutes_until_arrival"))
    by_station = F.to_json(F.struct(device.alias("station_id"), time, eta))
    shape = F.col("event_id") % 4
    text = (
        F.when(shape == 0, F.to_json(by_device))
        .when(shape == 1, F.to_json(F.create_map(device, keyed)))
        .when(shape == 2, F.concat(F.lit('{"entity":[{"device_id":"none"},'), by_station, F.lit("]}")))
        .otherwise(F.concat(F.lit("[7,"), F.to_json(by_device), F.lit("]")))
    )
    return text.alias("message")


def as_messages(table: DataFrame) -> DataFrame:
    return table.select(message())


def event_stream(spark: SparkSession, sf: str) -> DataFrame:
    table = events(spark, sf)
    reader = spark.readStream.schema(table.schema).option("pathGlobFilter", "events.parquet")
    return reader.parquet(sf)


def slight_part(files: int, low: int, high: int) -> Column:
    """The file of an event: by time, with up to a minute of one file in the next."""
    at = F.unix_micros(F.col("ts").cast("timestamp")) + F.pmod(F.xxhash64("event_id"), F.lit(60_000_000))
    return F.floor((at - low) * files / (high + 60_000_000 - low))


def planted_part(files: int, low: int, high: int) -> Column:
    """By time, but one event in 40 comes two files later, and one in 40 a file later."""
    part = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - low) * files / (high - low + 1))
    later = F.when(F.col("event_id") % 40 == 7, 2).when(F.col("event_id") % 40 == 9, 1).otherwise(0)
    return F.least(part + later, F.lit(files - 1))


def update_files(
    spark: SparkSession, sf: str, parts: int = 4, disorder: Callable[[int, int, int], Column] = slight_part
) -> tuple[str, int]:
    """The events as messages in text files, each in no order, and the files that make up a part.

    ``disorder`` says which part has an event. A part has as many files as its rows ask for, and a
    task writes one of each part, so what a task sorts is bounded by ``FILE_ROWS``.
    """
    path = new_path(spark, "messages")
    rows = events(spark, sf)
    ends = [F.unix_micros(F.col(c).cast("timestamp")) for c in ("low", "high")]
    low, high, n = rows.agg(F.min("ts").alias("low"), F.max("ts").alias("high"), F.count(F.lit(1)).alias("n")).select(*ends, "n").first()
    files = max(1, math.ceil(n / FILE_ROWS))
    dealt = rows.repartition(files, *rows.columns).select(disorder(parts, low or 0, high or 0).alias("part"), message())
    dealt.write.partitionBy("part").text(path)
    # The source takes files in the order of their times.
    new = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    folder = new(path)
    store = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [[f.getPath() for f in store.globStatus(new(folder, f"part={k}/*"))] for k in range(parts)]
    files = max(1, *map(len, found))
    for k, there in enumerate(found):
        # A part with fewer files than a batch takes would get some of the next one's.
        for i in range(files - len(there) if there else 0):
            there.append(new(folder, f"part={k}/empty-{i}.txt"))
            store.create(there[-1]).close()
        for file in there:
            store.setTimes(file, 1_700_000_000_000 + 1000 * k, -1)
    return f"{path}/*", files
