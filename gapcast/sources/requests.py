"""Forecast requests and responses as JSON."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gapcast.config import FUTURE_KNOWN, HISTORY_ONLY, SERIES, Config
from gapcast.functions.clock import strip_zone

# Fixed value: six digits; the default JSON format cuts to milliseconds.
JSON_OPTIONS = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}

NOT_A_LIST = "no rows: send a JSON list of rows, alone or under the name instances"

INSTANCE = T.StructType(
    [
        T.StructField("ds", T.StringType()),
        T.StructField("unique_id", T.StringType()),
        T.StructField("y", T.DoubleType()),
        *[T.StructField(c, T.DoubleType()) for c in (*FUTURE_KNOWN, *HISTORY_ONLY)],
    ]
)


def decode_requests(
    df: DataFrame, payload: str = "payload", key: Sequence[str] = ("request_id",), extra: T.StructType | None = None
) -> tuple[DataFrame, DataFrame]:
    """(rows, errors) of request payloads: {"instances": [...]} or a bare list.

    Rows keep their place in the request as ``idx`` and the request's length as ``n``,
    so they count as a numbered frame with ``by=key``. ``ds`` loses its zone. Besides
    the known columns, those of ``extra`` are read. Errors have ``error``.
    """
    known = {f.name for f in INSTANCE}
    fields = T.StructType([*INSTANCE, *[f for f in extra or () if f.name not in known]])
    data = F.try_parse_json(F.col(payload))
    inner = F.try_variant_get(data, "$.instances", "array<variant>")
    bare = F.try_variant_get(data, "$", "array<variant>")
    listed = F.coalesce(F.when(F.size(inner) > 0, inner), bare)
    read = df.select(*key, F.to_json(listed.cast("variant")).alias("_list"))
    typed = read.withColumn("_rows", F.from_json("_list", T.ArrayType(fields)))
    rows = (
        typed.where(F.col("_rows").isNotNull())
        .select(*key, F.size("_rows").cast("long").alias("n"), F.posexplode("_rows").alias("idx", "_r"))
        .select(*key, F.col("idx").cast("long").alias("idx"), "n", "_r.*")
        .withColumn("ds", strip_zone("ds").cast("timestamp"))
    )
    errors = typed.where(F.col("_rows").isNull()).select(*key, F.lit(NOT_A_LIST).alias("error"))
    return rows, errors


def build_requests(
    df: DataFrame, rows: int = Config.request_rows, by: Sequence[str] = (SERIES,), columns: Sequence[str] | None = None
) -> DataFrame:
    """by, ``payload``: the first rows of each numbered series under ``instances``."""
    hidden = {*by, "idx", "n", "chunk"}
    shown = list(columns or [c for c in df.columns if c not in hidden])
    record = F.struct("idx", F.struct(F.concat_ws("|", *by).alias("unique_id"), *shown).alias("row"))
    first = df.where(F.col("idx") < rows).groupBy(*by).agg(F.sort_array(F.collect_list(record)).alias("_r"))
    instances = F.transform("_r", lambda r: r["row"])
    return first.select(*by, F.to_json(F.struct(instances.alias("instances")), JSON_OPTIONS).alias("payload"))


def encode_response(forecasts: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """key, ``response``: the forecast rows of each request under ``predictions``.

    A request holds a horizon's worth of rows, so its list is short.
    """
    shown = [c for c in forecasts.columns if c not in key]
    record = F.struct(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], F.struct(*shown).alias("row"))
    listed = forecasts.groupBy(*key).agg(F.sort_array(F.collect_list(record)).alias("_r"))
    predictions = F.transform("_r", lambda r: r["row"])
    return listed.select(*key, F.to_json(F.struct(predictions.alias("predictions")), JSON_OPTIONS).alias("response"))
