import json

import pytest
from pyspark.sql import functions as F

from gapcast.functions.messages import parse_updates

R = {"timestamp": "t", "minutes_until_arrival": 3}
A = {"device_id": "A1", **R}

CASES = [
    ("top level", A, ("A1", "t", 3.0)),
    ("by station", {"station_id": "A1", **R}, ("A1", "t", 3.0)),
    ("keyed", {"A1": {"timestamp": "t", "minutes_until_arrival": "4.5"}}, ("A1", "t", 4.5)),
    ("entity list", {"entity": [{"device_id": "B"}, {"station_id": "A1", **R}]}, ("A1", "t", 3.0)),
    ("bare list with junk", [7, A], ("A1", "t", 3.0)),
    ("entity list, junk first", {"entity": [7, A]}, None),
    ("entity list, junk after", {"entity": [A, 7]}, ("A1", "t", 3.0)),
    ("two matches", [A, {**A, "minutes_until_arrival": 9}], ("A1", "t", 3.0)),
    ("two matches, first void", [{**A, "timestamp": ""}, A], None),
    ("data list", {"data": [A]}, None),
    ("zero eta", {**A, "minutes_until_arrival": 0}, ("A1", "t", 0.0)),
    ("true is one", {**A, "minutes_until_arrival": True}, ("A1", "t", 1.0)),
    ("number timestamp", {**A, "timestamp": 17}, ("A1", "17", 3.0)),
    ("zero timestamp", {**A, "timestamp": 0}, None),
    ("zero text timestamp", {**A, "timestamp": "0"}, ("A1", "0", 3.0)),
    ("empty timestamp", {**A, "timestamp": ""}, None),
    ("no timestamp", {"device_id": "A1", "minutes_until_arrival": 3}, None),
    ("null value", {**A, "minutes_until_arrival": None}, None),
    ("text value", {**A, "minutes_until_arrival": "soon"}, None),
    ("list value", {**A, "minutes_until_arrival": [1]}, None),
    ("number device is no name", {**A, "device_id": 1}, None),
    ("keyed by a non-object", {"A1": 5}, None),
    ("a keyed non-object hides the entity list", {"A1": 5, "entity": [A]}, None),
    ("top level before key", {**A, "A1": {"timestamp": "u", "minutes_until_arrival": 8}}, ("A1", "t", 3.0)),
    ("key before entity", {"A1": {"timestamp": "u", "minutes_until_arrival": 8}, "entity": [A]}, ("A1", "u", 8.0)),
    ("other station", {**A, "device_id": "B"}, None),
    ("scalar", 5, None),
    ("empty", {}, None),
]


@pytest.fixture(scope="module")
def parsed(spark):
    rows = [(name, json.dumps(message)) for name, message, _ in CASES] + [("bad JSON", "{oops"), ("null", None)]
    df = spark.createDataFrame(rows, "name string, message string")
    found = {r.name: (r.target, r.timestamp, r.eta) for r in parse_updates(df, targets=["A1"]).collect()}
    raw = df.withColumn("message", F.encode("message", "UTF-8"))
    as_bytes = {r.name: (r.target, r.timestamp, r.eta) for r in parse_updates(raw, targets=["A1"]).collect()}
    assert found == as_bytes
    return found


@pytest.mark.parametrize("name,want", [(name, want) for name, _, want in CASES] + [("bad JSON", None), ("null", None)])
def test_shapes(parsed, name, want):
    assert parsed.get(name) == want


def test_all_stations_of_a_message(spark):
    message = {"entity": [A, {"station_id": "B2", **R}, {"device_id": "C3", "station_id": "D4", **R}]}
    df = spark.createDataFrame([(json.dumps(message),)], "message string")
    assert sorted(r.target for r in parse_updates(df).collect()) == ["A1", "B2", "C3", "D4"]
    wanted = spark.createDataFrame([("B2",), ("D4",), ("E5",)], "target string")
    assert sorted(r.target for r in parse_updates(df, targets=wanted).collect()) == ["B2", "D4"]
    with pytest.raises(ValueError):
        parse_updates(df, targets=[])


def test_bytes_that_are_no_text(spark):
    df = spark.createDataFrame([(bytearray(b"\xff\xfe{}"),)], "message binary")
    assert parse_updates(df, targets=["A1"]).count() == 0
