"""Reading a station's ETA out of JSON messages of several shapes.

The rules, for one target station and one message (object or list):

1. an object naming the station in ``device_id`` or ``station_id`` is the record;
2. else a value keyed by the station is;
3. else the first match in the ``entity`` list, unless an item before it is not an
   object, which voids the message;
4. in a bare list, the first matching object; other items are skipped.

The record gives a row if its ``timestamp`` is not empty and its
``minutes_until_arrival`` is a number or text of one. All targets of a message are
read in one pass over it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapcast.functions.numbers import safe_double

# Texts of JSON values that count as empty when they are not strings.
EMPTY_TEXTS = ("0", "-0", "0.0", "-0.0", "false", "{}", "[]")


def _member(item: Column, key: str) -> Column:
    return F.try_variant_get(item, f"$.{key}", "variant")


def _text(value: Column) -> Column:
    return F.try_variant_get(value, "$", "string")


def _kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def _is_object(value: Column) -> Column:
    return F.coalesce(F.startswith(_kind(value), F.lit("OBJECT")), F.lit(False))


def _name(item: Column, key: str) -> Column:
    """The member if it is a string: a number never equals a station name."""
    member = _member(item, key)
    return F.when(_kind(member) == "STRING", _text(member))


def _timestamp(item: Column) -> Column:
    member = _member(item, "timestamp")
    text = _text(member)
    filled = F.when(_kind(member) == "STRING", text != "").otherwise(~text.isin(*EMPTY_TEXTS))
    return F.when(filled, text)


def _eta(item: Column) -> Column:
    member = _member(item, "minutes_until_arrival")
    return (
        F.when(_kind(member) == "STRING", safe_double(_text(member)))
        .when(_kind(member) == "BOOLEAN", F.try_variant_get(member, "$", "boolean").cast("double"))
        .otherwise(F.try_variant_get(member, "$", "double"))
    )


def _place(target: Column, rank: int, at: Column) -> Column:
    return F.struct(target.alias("target"), F.lit(rank).alias("rank"), at.cast("int").alias("at"))


def _named(item: Column, rank: int, at: Column) -> Column:
    return F.array(_place(_name(item, "device_id"), rank, at), _place(_name(item, "station_id"), rank, at))


def _listed(items: Column, rank: int) -> Column:
    return F.flatten(F.transform(items, lambda item, at: _named(item, rank, at)))


def _places() -> Column:
    """Where each station is found: (target, rank of the rule, place in its list)."""
    # A value without a timestamp gives no row; it matters only before an entity list.
    keys = F.filter(
        F.map_keys("_object"),
        lambda key: F.col("_entity").isNotNull() | _member(F.col("_object")[key], "timestamp").isNotNull(),
    )
    by_key = F.transform(keys, lambda key: _place(key, 2, F.lit(0)))
    odd = F.array_position(F.transform("_entity", _is_object), F.lit(False)).cast("int")
    before_odd = F.when(odd > 0, F.slice("_entity", F.lit(1), odd - 1)).otherwise(F.col("_entity"))
    none = F.array().cast("array<struct<target:string,rank:int,at:int>>")
    in_entity = F.when(F.col("_entity").isNotNull(), _listed(before_odd, 3)).otherwise(none)
    in_object = F.concat(_named(F.col("_data"), 1, F.lit(0)), by_key, in_entity)
    return (
        F.when(F.col("_object").isNotNull(), in_object)
        .when(F.col("_list").isNotNull(), _listed(F.col("_list"), 4))
        .otherwise(none)
    )


def parse_updates(
    df: DataFrame, message: str = "message", targets: list[str] | DataFrame | None = None
) -> DataFrame:
    """One row (target, timestamp, eta) per message and station that yields one.

    ``targets`` is a short list of stations, or a frame with a ``target`` column for
    many; None keeps every station. Works on static and streaming frames.
    """
    if targets == []:
        raise ValueError("no target station given")
    source = F.col(message)
    if dict(df.dtypes)[message] == "binary":
        source = F.when(F.is_valid_utf8(source.cast("string")), source.cast("string"))
    kept = [c for c in df.columns if c != message]
    parsed = df.select(*kept, F.try_parse_json(source).alias("_data"))
    shapes = parsed.select(
        "*",
        F.try_variant_get("_data", "$", "map<string,variant>").alias("_object"),
        F.try_variant_get("_data", "$.entity", "array<variant>").alias("_entity"),
        F.try_variant_get("_data", "$", "array<variant>").alias("_list"),
    )
    wanted = F.filter(
        _places(),
        lambda c: c["target"].isin(*targets) if isinstance(targets, list) else c["target"].isNotNull(),
    )
    ordered = shapes.withColumn("_places", F.array_sort(wanted))
    # Sorted by (target, rank, at): the first of each target is where its record lies.
    first = F.filter(
        "_places",
        lambda c, k: (k == 0) | (F.get(F.col("_places"), k - 1)["target"] != c["target"]),
    )
    found = ordered.withColumn("_at", F.explode(first))
    item = (
        F.when(F.col("_at.rank") == 1, F.col("_data"))
        .when(F.col("_at.rank") == 2, F.col("_object")[F.col("_at.target")])
        .when(F.col("_at.rank") == 3, F.get("_entity", F.col("_at.at")))
        .otherwise(F.get("_list", F.col("_at.at")))
    )
    records = found.select(*kept, F.col("_at.target").alias("target"), item.alias("_item"))
    read = F.struct(_timestamp(F.col("_item")).alias("timestamp"), _eta(F.col("_item")).alias("eta"))
    # A generator keeps the filter from being pushed below, where it would read twice.
    rows = records.select(*kept, "target", F.inline(F.array(read))).where(
        F.col("timestamp").isNotNull() & F.col("eta").isNotNull()
    )
    if isinstance(targets, DataFrame):
        rows = rows.join(targets.select("target").distinct(), "target", "left_semi")
    return rows
