"""Readers for arrivals, weather, windows, predictions and live updates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gapcast.config import REQUIRED_COLUMNS, WEATHER_COLUMNS
from gapcast.functions.numbers import nan_to_null
from gapcast.operators.arrivals import latest_per_key
from gapcast.operators.columns import require_columns

# Fixed value: the default extract query.
EXTRACT_QUERY = "SELECT arrival_date, duration, mbt, dow FROM {table}"

# Fixed value: stored field -> column of the review frame.
PREDICTION_FIELDS = {
    "doc_id": "doc_id",
    "timestamp_str": "time",
    "route_id": "route",
    "stop_id": "stop",
    "predicted_mbt": "pred_mbt",
    "status": "status",
    "created_at": "created",
}

ARRIVALS = T.StructType(
    [
        T.StructField("arrival_date", T.TimestampType()),
        T.StructField("duration", T.DoubleType()),
        T.StructField("mbt", T.DoubleType()),
        T.StructField("dow", T.IntegerType()),
    ]
)
WEATHER = T.StructType(
    [T.StructField("datetime", T.TimestampType())] + [T.StructField(c, T.DoubleType()) for c in WEATHER_COLUMNS]
)
UPDATES = T.StructType([T.StructField("value", T.StringType())])


def extract(spark: SparkSession, query: str | None = None, table: str = "arrivals") -> DataFrame:
    """The result of one SQL query over the session's tables and views."""
    return spark.sql(query or EXTRACT_QUERY.format(table=table))


def _headed(spark: SparkSession, path: str, wanted: T.StructType) -> DataFrame:
    """CSV with a header; columns by name, in any order, with the wanted types; NaN is null.

    All files of a folder must have the same header: one that differs is an error.
    """
    text = spark.read.option("header", True).option("enforceSchema", False).csv(path)
    types = {f.name: f.dataType for f in wanted}
    typed = text.select(*[F.col(c).cast(types[c]).alias(c) if c in types else F.col(c) for c in text.columns])
    return nan_to_null(typed, [f.name for f in typed.schema if isinstance(f.dataType, T.DoubleType)])


def read_arrivals_csv(spark: SparkSession, path: str, schema: T.StructType = ARRIVALS) -> DataFrame:
    """Arrivals by column name; a missing required column is an error."""
    return require_columns(_headed(spark, path, schema), REQUIRED_COLUMNS)


def read_positional(spark: SparkSession, path: str, target_pos: int = 1) -> tuple[DataFrame, str]:
    """All columns but the first as doubles, and the name of the target among them."""
    text = spark.read.option("header", True).csv(path)
    numbers = text.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in text.columns[1:]])
    return numbers, numbers.columns[target_pos]


def read_weather(spark: SparkSession, path: str | None) -> DataFrame | None:
    """Hourly weather with whichever of the known columns are present.

    None if there is no such file: the weather step is then left out.
    """
    if path is None:
        return None
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return None
    table = _headed(spark, path, WEATHER)
    return table.select(*[c for c in WEATHER.names if c in table.columns])


def stored_documents(spark: SparkSession, path: str) -> DataFrame:
    """Every stored version of every prediction document."""
    return spark.read.parquet(path).drop("writer", "batch")


def read_predictions(spark: SparkSession, path: str, limit: int | None = None, versions: bool = False) -> DataFrame:
    """Stored predictions, newest first and by document among those, under the review names.

    One document per route, stop and time: the newest. ``versions`` shows all that were stored.
    """
    documents = stored_documents(spark, path)
    ordered = (documents if versions else latest_per_key(documents)).orderBy(F.desc("timestamp"), "doc_id")
    rows = ordered if limit is None else ordered.limit(limit)
    return rows.select(*[F.col(stored).alias(shown) for stored, shown in PREDICTION_FIELDS.items()])


def load_scaler(spark: SparkSession, path: str) -> DataFrame:
    """The stored mean and std of each feature, as ``fit_scaler`` returned them."""
    return require_columns(spark.read.parquet(path), ("feature", "mean", "std"))


def load_windows(
    spark: SparkSession, path: str, split: str | None = "test", schema: T.StructType | None = None
) -> DataFrame:
    """Stored windows; ``split`` prunes to one partition of them.

    With a ``schema`` a folder without any window reads as an empty frame.
    """
    windows = (spark.read.schema(schema) if schema else spark.read).parquet(path)
    return windows if split is None else windows.where(F.col("split") == split)


def read_vehicle_updates(
    spark: SparkSession, path: str | None = None, files_per_batch: int | None = None, **kafka: str
) -> DataFrame:
    """Stream of JSON messages, one per line in files, or from Kafka options.

    Column ``message``. The rows of a batch, and so the work on a hot station, are
    bounded by ``files_per_batch`` or Kafka's ``maxOffsetsPerTrigger``.
    """
    if path is None:
        reader = spark.readStream.format("kafka").options(**kafka)
        return reader.load().select(F.col("value").cast("string").alias("message"))
    reader = spark.readStream.schema(UPDATES)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.text(path).withColumnRenamed("value", "message")
