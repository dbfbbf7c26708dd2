import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gapcast.config import ROLLING_FEATURES
from gapcast.operators.fill import backward_fill, forward_fill
from gapcast.operators.rolling import headways, naive_forecast, rolling, with_headway
from gapcast.plans import layout
from gapcast.plans.layout import attach, lay_out, number, positions, renumber, shifted, with_blocks
from gapcast.plans.scratch import store
from tests.helpers import lopsided, ordered

ORDER = ["ds", "tie", "y"]


@pytest.fixture(scope="module")
def table():
    return lopsided()


def _numbered(spark, table, chunks=7):
    return positions(spark.createDataFrame(table), ORDER, chunks=chunks)


def _pandas(df, *by):
    return df.toPandas().sort_values(list(by)).reset_index(drop=True)


@pytest.mark.parametrize("chunks", [1, 7])
def test_positions_equal_a_plain_sort(spark, table, chunks):
    mine = _pandas(_numbered(spark, table, chunks), "series_id", "idx")
    want = ordered(table)
    for column in ("series_id", "ds", "tie", "y", "idx", "n"):
        assert mine[column].tolist() == want[column].tolist(), column


def test_a_hot_series_and_copies_spread_over_chunks(spark, table):
    sizes = lay_out(spark.createDataFrame(table), ORDER, chunks=9).groupBy("chunk").count().toPandas()["count"]
    assert len(sizes) >= 7 and sizes.max() < len(table) / 3
    same = pd.DataFrame({"series_id": ["x"] * 2000, "ds": [table.ds[0]] * 2000, "tie": 1, "y": 2.0})
    copies = lay_out(spark.createDataFrame(same), ORDER, chunks=8).groupBy("chunk").count().toPandas()["count"]
    assert len(copies) >= 6 and copies.sum() == 2000 and copies.max() < 700


def test_positions_without_group(spark, table):
    mine = positions(spark.createDataFrame(table), ["y", "ds", "tie"], by=(), chunks=5)
    assert sorted(r.idx for r in mine.select("idx").collect()) == list(range(len(table)))
    values = _pandas(mine, "idx")["y"]
    assert values.is_monotonic_increasing


def test_renumber_after_a_filter(spark, table):
    laid = lay_out(spark.createDataFrame(table), ORDER, chunks=7)
    mine = _pandas(renumber(laid.where("y <= 8")), "series_id", "idx")
    want = ordered(table[table.y <= 8])
    assert mine[["series_id", "y", "idx", "n"]].values.tolist() == want[["series_id", "y", "idx", "n"]].values.tolist()


def test_blocks_hold_whole_frames(spark, table):
    framed = with_blocks(_numbered(spark, table), before=4, after=2, block_rows=10).toPandas()
    assert (~framed.halo).sum() == len(table)
    sizes = framed.groupby(["series_id", "block"]).size()
    assert sizes.max() <= 10 + 4 + 2
    for (_, block), group in framed.groupby(["series_id", "block"]):
        own = group[~group.halo]
        assert len(own), "no block of border rows alone"
        first, last, n = own.idx.min(), own.idx.max(), group.n.iloc[0]
        want = range(max(0, first - 4), min(n, last + 3))
        assert sorted(group.idx) == list(want)


@pytest.mark.parametrize("block_rows,chunks", [(50, 7), (64, 1), (8192, 3)])
def test_rolling_equals_pandas(spark, table, block_rows, chunks):
    numbered = _numbered(spark, table, chunks)
    mine = _pandas(rolling(numbered, dense=True, block_rows=block_rows), "series_id", "idx")
    general = _pandas(rolling(numbered, block_rows=block_rows), "series_id", "idx")
    want = ordered(table)
    for name, fn, width in ROLLING_FEATURES:
        column = want.groupby("series_id")["y"].transform(lambda s: getattr(s.rolling(width), fn)().bfill())
        np.testing.assert_allclose(mine[name].astype(float), column, atol=1e-9, err_msg=name)
        np.testing.assert_allclose(general[name].astype(float), column, atol=1e-9, err_msg=name)


def test_rolling_with_nulls(spark):
    # Window 3 over 1,2,null,4,5,6 has one full window.
    rows = pd.DataFrame({"series_id": "a", "ds": pd.date_range("2024-01-01", periods=6, freq="h"), "y": [1, 2, None, 4, 5, 6.0]})
    numbered = positions(spark.createDataFrame(rows), ["ds"], chunks=3)
    features = [("std", "std", 3), ("mean", "mean", 3)]
    plain = _pandas(rolling(numbered, "y", features, fill=False, block_rows=3), "idx")
    assert plain["std"].isna().tolist() == [True] * 5 + [False] and plain["std"].iloc[-1] == 1.0
    filled = _pandas(rolling(numbered, "y", features, block_rows=3), "idx")
    assert filled["mean"].tolist() == [5.0] * 6


def test_series_shorter_than_the_window_stays_null(spark, table):
    one = rolling(_numbered(spark, table)).where("series_id = 'one'").first()
    assert one.rolling_mean_10 is None and one.rolling_std_50 is None


def test_fills_equal_pandas(spark, table):
    holes = ordered(table)
    holes.loc[(holes.idx % 5 != 2) | (holes.idx.between(100, 380)), "y"] = None
    laid = lay_out(spark.createDataFrame(holes), ["ds", "tie", "idx"], chunks=7)
    by = holes.groupby("series_id")["y"]
    for fill, want in ((forward_fill, by.ffill()), (backward_fill, by.bfill())):
        mine = _pandas(fill(laid, ["y"], order="gid"), "series_id", "idx")["y"]
        np.testing.assert_array_equal(mine.astype(float), want)


def test_headway_over_chunk_borders(spark, table):
    laid = lay_out(spark.createDataFrame(table), ORDER, chunks=11)
    mine = _pandas(number(with_headway(laid)), "series_id", "idx")["mbt"]
    want = ordered(table).groupby("series_id")["ds"].diff().dt.total_seconds() / 60
    np.testing.assert_allclose(mine.astype(float), want, rtol=1e-12)


def test_headway_rules(spark):
    # 0.5 min after the first is dropped, yet it is the predecessor of the next; 1.0 is kept.
    at = [0, 0.5, 1.5, 9.0]
    stamps = [pd.Timestamp("2024-01-01") + pd.Timedelta(minutes=m) for m in reversed(at)]
    rows = pd.DataFrame({"series_id": "a", "ds": stamps})
    lonely = pd.DataFrame({"series_id": ["b", "c", "c"], "ds": [stamps[0], stamps[0], stamps[0] + pd.Timedelta(seconds=59)]})
    source = spark.createDataFrame(pd.concat([rows, lonely]))
    got = _pandas(headways(source, chunks=3), "series_id", "ds")
    assert got.series_id.tolist() == ["a", "a"] and got.y.tolist() == [1.0, 7.5]
    many = pd.DataFrame({"series_id": "a", "ds": pd.date_range("2024-01-01", periods=200, freq="7min")})
    kept = headways(spark.createDataFrame(many)).toPandas()
    assert len(kept) == 150 and kept.ds.max() == many.ds.max()


def test_shifts_and_naive(spark, table):
    numbered = _numbered(spark, table)
    want = ordered(table)
    mine = _pandas(shifted(numbered, {"lag2": ("y", 2), "next": ("y", -1)}, block_rows=16), "series_id", "idx")
    by = want.groupby("series_id")["y"]
    np.testing.assert_array_equal(mine["lag2"].astype(float), by.shift(2))
    np.testing.assert_array_equal(mine["next"].astype(float), by.shift(-1))
    assert naive_forecast(numbered, block_rows=16).where("naive IS NULL").count() == 3


@pytest.mark.parametrize("limit", ["10MB", "-1"])
def test_attach_keeps_every_row(spark, table, limit):
    rows = _numbered(spark, table)
    facts = store(spark.createDataFrame([("hot", 1.0), ("mid", 2.0)], "series_id string, fact double"), "facts")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    try:
        joined = attach(rows, facts, ["series_id"], ["idx"])
        got = joined.groupBy("series_id").agg(F.count("*").alias("k"), F.max("fact").alias("f")).toPandas()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert dict(zip(got.series_id, got.k)) == {"hot": 600, "mid": 299, "one": 1}
    assert got.set_index("series_id").f.loc["hot"] == 1.0 and np.isnan(got.set_index("series_id").f.loc["one"])


def test_window_groups_are_bounded(spark, table):
    """No window group is a whole series: each is keyed by block or chunk too."""
    plan = rolling(_numbered(spark, table), block_rows=64)._jdf.queryExecution().optimizedPlan().toString()
    keys = [line for line in plan.splitlines() if line.strip(" :+-").startswith("Window")]
    assert keys and all("block#" in line or "chunk#" in line for line in keys)


def test_bytes_settings():
    assert [layout._bytes(t) for t in ("10485760b", "10MB", "-1", "64k", "1g")] == [10485760, 10485760, -1, 65536, 1 << 30]


def test_a_null_key_is_an_error(spark):
    rows = spark.createDataFrame([(None, 1.0), ("a", 2.0)], "series_id string, y double")
    with pytest.raises(Exception, match="null in key column series_id"):
        lay_out(rows, ["y"])


def test_partitions_follow_the_stored_bytes():
    assert layout.chunk_count(100 * 10**12, 200) == 745_059
    assert layout.chunk_count(10**9, 200) is None and layout.chunk_count(layout.CHUNK_BYTES * 201, 200) == 201


def test_joins_do_not_inflate_the_size(spark, table):
    base = store(spark.createDataFrame(table), "sized")
    alone = layout.stored_bytes(base)
    joined = base.join(base.groupBy("series_id").count(), "series_id").join(base.select("series_id", "tie"), ["series_id", "tie"])
    assert layout.plan_bytes(joined) > 100 * alone
    assert layout.stored_bytes(joined) == 3 * alone


def test_only_hot_keys_are_copied(spark, table):
    rows = _numbered(spark, table)
    facts = store(spark.createDataFrame([("hot", 1.0), ("mid", 2.0), ("one", 3.0)], "series_id string, fact double"), "facts")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = attach(rows, facts, ["series_id"], ["idx"], hot_rows=400)
        got = {r["series_id"]: (r["k"], r["f"]) for r in joined.groupBy("series_id").agg(F.count("*").alias("k"), F.max("fact").alias("f")).collect()}
        files = [f for f in joined.inputFiles() if "hot_keys" in f]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == {"hot": (600, 1.0), "mid": (299, 2.0), "one": (1, 3.0)}
    assert [tuple(r) for r in spark.read.parquet(*files).collect()] == [("hot", 2)]
