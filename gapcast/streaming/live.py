"""The live half: messages -> arrivals -> headways -> features -> forecasts.

Batch and stream share the column expressions. Observations newer than the watermark are
held, and taken up in time order once it has passed them, so the result does not depend
on how files fall into micro-batches; what comes later than the watermark allows is
dropped by Spark, counted (``freshness``) and kept apart (``late.py``). State per series is the
last ETA, the last arrival, at most ``history`` gaps, and the observations of the watermark's
span. Series are dealt by hash into ``GROUPS`` groups, which have their state tables, and a timer
for the next row due, in common. A micro-batch hands one group to one task, so its size
(``files_per_batch``, ``maxOffsetsPerTrigger``) is the bound on what a hot station can put there.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from gapcast.config import ROLLING_FEATURES, SERIES, Config
from gapcast.functions.clock import minutes_between, parse_ts, round_hour, weekend_flag
from gapcast.functions.messages import parse_updates
from gapcast.operators.arrivals import live_columns
from gapcast.operators.forecast import score
from gapcast.operators.weather import filled_hours, join_filled
from gapcast.plans.scratch import new_path

WATERMARK = "2 minutes"
POLL = "30 seconds"
#: Groups of series that share their state tables; a checkpoint holds for one number of them.
GROUPS = 256
#: Rows of one packed table and of one part of the output.
PACK = 16_384
NEVER = np.iinfo(np.int64).min
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def parse_stream(messages: DataFrame, targets=None, message: str = "message") -> DataFrame:
    """series_id, ``ts``, ``eta`` from JSON messages, with the watermark set."""
    rows = parse_updates(messages, message, targets)
    timed = rows.select(
        F.col("target").alias(SERIES), parse_ts("timestamp", strict=False).alias("ts"), F.col("eta").alias("eta")
    )
    return timed.where(F.col("ts").isNotNull()).withWatermark("ts", WATERMARK)


def tumbling_snapshots(updates: DataFrame, width: str = "1 minute") -> DataFrame:
    """Per series and window: count, least ETA, last ETA. Closed windows only."""
    windows = updates.groupBy(SERIES, F.window("ts", width))
    return windows.agg(
        F.count(F.lit(1)).alias("updates"), F.min("eta").alias("min_eta"), F.max_by("eta", "ts").alias("last_eta")
    ).select(
        SERIES,
        F.col("window.start").alias("window_start"),
        F.col("window.end").alias("window_end"),
        "updates",
        "min_eta",
        "last_eta",
    )


def _micros(ts: pd.Series) -> np.ndarray:
    return ts.to_numpy("datetime64[us]").astype(np.int64)


def _times(micros: np.ndarray) -> np.ndarray:
    return micros.astype("datetime64[us]")


def _packed(table: pd.DataFrame) -> bytes:
    """A table as the bytes of an Arrow stream."""
    arrow, sink = pa.Table.from_pandas(table, preserve_index=False), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, arrow.schema) as out:
        out.write_table(arrow)
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(data).read_pandas()


@dataclass
class _Taken:
    """Observations in order, series by series, with what is known of each series before them.

    A stretch has no idle time in it; it is ``fresh`` if it begins after one.
    """

    names: pd.Index
    code: np.ndarray  # the series of each observation, as a place in ``names``
    at: np.ndarray
    eta: np.ndarray
    arrival: np.ndarray
    stretch: np.ndarray
    first: np.ndarray  # where each stretch begins
    fresh: np.ndarray  # of each stretch


class _Observations(StatefulProcessor):
    """Holds the observations of a group of series until the watermark has passed them, then takes them up in order.

    State tables: ``held`` is a list that the rows of a batch are appended to as one packed table,
    and that is read only when its first row is due; ``known`` has a packed table of the last ETA
    taken up and its time by series, and what else the step keeps (``extra``); ``due`` says what
    is awaited. A call to the state costs a round trip, and so does a series in the state, so
    the series of a group share both.
    """

    def __init__(self, idle: str | None, jump: float):
        self.idle = None if idle is None else int(pd.Timedelta(idle).total_seconds() * 1_000_000)
        self.jump = jump

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "rows binary")
        self.known = handle.getValueState("known", "series binary, extra binary")
        self.due = handle.getValueState("due", "first_held long, first_seen long, timer long")

    def take(self, taken: _Taken, extra: Any) -> tuple[Iterator[pd.DataFrame], Any]:
        """What follows from observations, and the extra state by ``taken.names``."""
        raise NotImplementedError

    def unpack(self, extra: bytes | None, size: int) -> Any:
        """The extra state of as many series as are known, with room for ``size``."""
        return None

    def pack(self, extra: Any, stay: np.ndarray) -> bytes:
        return b""

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        parts = [pd.DataFrame({SERIES: b[SERIES], "at": _micros(b["ts"]), "eta": b["eta"].to_numpy(float)}).dropna(subset="eta") for b in rows]
        yield from self._step([p for p in parts if len(p)], timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._step([], timerValues.getCurrentWatermarkInMs())

    def _step(self, new: list[pd.DataFrame], watermark: int) -> Iterator[pd.DataFrame]:
        mark = watermark * 1000
        first, seen, timer = self.due.get() or (None, None, None)
        held, first = first is not None, min([int(p["at"].min()) for p in new] + ([] if first is None else [first]), default=None)
        if (first is None or first > mark) and not (seen is not None and self.idle is not None and seen + self.idle <= mark):
            # Nothing is due: what is held need not be read.
            if new:
                self.held.appendList([(_packed(p),) for p in new])
        else:
            if held:
                new = new + [_unpacked(r[0]) for r in self.held.get()]
            rows = pd.concat(new, ignore_index=True) if new else pd.DataFrame({SERIES: pd.Series([], dtype=object), "at": np.zeros(0, np.int64), "eta": np.zeros(0)})
            now = rows["at"].to_numpy() <= mark
            rest = rows[~now]
            if len(rest):
                self.held.put([(_packed(rest.iloc[k : k + PACK]),) for k in range(0, len(rest), PACK)])
            elif held:
                self.held.clear()
            first = int(rest["at"].min()) if len(rest) else None
            out, seen = self._take(rows[now], mark)
            yield from out
        awaited = [] if first is None else [first]
        if self.idle is not None and seen is not None:
            awaited.append(seen + self.idle)
        wake = max(min(awaited) // 1000 - 1, watermark + 1) if awaited else None
        if wake != timer:
            if timer is not None and timer > watermark:
                self.handle.deleteTimer(timer)
            if wake is not None:
                self.handle.registerTimer(wake)
        if first is None and seen is None:
            self.due.clear()
        else:
            self.due.update((first, seen, wake))

    def _take(self, rows: pd.DataFrame, mark: int) -> tuple[Iterator[pd.DataFrame], int | None]:
        """The output of rows that are due, and the earliest time that a series kept was last seen."""
        stored = self.known.get()
        known = _unpacked(stored[0]) if stored else None
        names = rows[SERIES] if known is None else pd.concat([known[SERIES], rows[SERIES]])
        codes, names = pd.factorize(names, use_na_sentinel=False)
        there = 0 if known is None else len(known)
        last, seen = np.full(len(names), np.nan), np.full(len(names), NEVER)
        if known is not None:
            last[:there], seen[:there] = known["last"], known["seen"]
        at, eta, code = rows["at"].to_numpy(), rows["eta"].to_numpy(), codes[there:]
        order = np.lexsort([eta, at, code])
        at, eta, code = at[order], eta[order], code[order]
        begins = np.concatenate([[True], code[1:] != code[:-1]]) if len(code) else np.zeros(0, bool)
        before, since = np.roll(eta, 1), np.roll(at, 1)
        before[begins], since[begins] = last[code[begins]], seen[code[begins]]
        # Stretches without an idle time in them, whichever batches their rows came in.
        cut = np.zeros(len(at), bool) if self.idle is None else (since != NEVER) & (at - np.maximum(since, 0) >= self.idle)
        before[cut] = np.nan
        place = np.flatnonzero(begins | cut)
        stretch = np.cumsum(begins | cut) - 1
        taken = _Taken(names, code, at, eta, eta > before + self.jump, stretch, place, cut[place])
        out, extra = self.take(taken, self.unpack(stored[1] if stored else None, len(names)))
        # In order: the last one of a series stays.
        last[code], seen[code] = eta, at
        stay = np.ones(len(names), bool) if self.idle is None else seen + self.idle > mark
        if stay.any():
            table = pd.DataFrame({SERIES: names[stay], "last": last[stay], "seen": seen[stay]})
            self.known.update((_packed(table), self.pack(extra, stay)))
        elif stored:
            self.known.clear()
        return out, int(seen[stay].min()) if stay.any() else None


class _Detect(_Observations):
    def take(self, taken, extra):
        out = pd.DataFrame({SERIES: taken.names[taken.code], "ts": _times(taken.at), "eta": taken.eta, "arrival": taken.arrival})
        return (out.iloc[k : k + PACK] for k in range(0, len(out), PACK)), extra


class _Features(_Observations):
    """Detection, accumulation, the headway rule, padding and rolling.

    Extra state by series: the last arrival, and the last ``history`` gaps. Without ``windows``
    only the headways themselves follow.
    """

    def __init__(self, history: int, min_gap: float, jump: float, idle: str | None, windows: bool = True):
        super().__init__(idle, jump)
        self.history, self.min_gap, self.windows = history, min_gap, windows

    def unpack(self, extra, size):
        arrived, gaps = np.full(size, NEVER), [np.zeros(0)] * size
        if extra:
            table = pa.ipc.open_stream(extra).read_all()
            arrived[: table.num_rows] = table.column("arrived").to_numpy()
            lists = table.column("gaps").combine_chunks()
            ends, values = lists.offsets.to_numpy(), lists.values.to_numpy()
            gaps[: table.num_rows] = [values[a:b] for a, b in zip(ends, ends[1:])]
        return arrived, gaps

    def pack(self, extra, stay):
        arrived, gaps = extra
        kept = [gaps[i] for i in np.flatnonzero(stay)]
        ends = np.cumsum([0, *map(len, kept)]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(kept)))
        table, sink = pa.table({"arrived": arrived[stay], "gaps": lists}), pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as out:
            out.write_table(table)
        return sink.getvalue().to_pybytes()

    def take(self, taken, extra):
        arrived, gaps = extra
        code_of = taken.code[taken.first]
        at, stretch = taken.at[taken.arrival], taken.stretch[taken.arrival]
        begins = np.concatenate([[True], stretch[1:] != stretch[:-1]]) if len(at) else np.zeros(0, bool)
        before = np.roll(at, 1)
        before[begins] = np.where(taken.fresh[stretch[begins]], NEVER, arrived[code_of[stretch[begins]]])
        known = before != NEVER
        y = np.where(known, at - np.where(known, before, at), 0) / 6e7
        keep = known & (y >= self.min_gap)
        y, ends, of = y[keep], at[keep], stretch[keep]
        # In order: the last stretch of a series decides.
        arrived[code_of[taken.fresh]] = NEVER
        final = np.full(len(taken.names), -1)
        final[code_of] = np.arange(len(code_of))
        latest = final[code_of[stretch]] == stretch
        arrived[code_of[stretch[latest]]] = at[latest]
        counts = np.bincount(of, minlength=len(code_of))
        stops = np.cumsum(counts)
        pad = max(self.history, *[w for _, _, w in ROLLING_FEATURES])
        flat, spots, size = [np.zeros(0)], [np.zeros(0, np.int64)], 0
        for s in np.flatnonzero(taken.fresh | (counts > 0)):
            c = code_of[s]
            if taken.fresh[s]:
                gaps[c] = np.zeros(0)
            if counts[s]:
                everything = np.concatenate([gaps[c], y[stops[s] - counts[s] : stops[s]]])
                gaps[c] = everything[-self.history :]
                if self.windows:
                    flat += [np.full(pad, everything[0]), everything]
                    size += pad + len(everything)
                    spots.append(np.arange(size - counts[s], size))
        out = {SERIES: taken.names[code_of[of]], "ds": _times(ends), "y": y}
        return self._rows(out, np.concatenate(flat), np.concatenate(spots)), (arrived, gaps)

    def _rows(self, out: dict[str, Any], padded: np.ndarray, spots: np.ndarray) -> Iterator[pd.DataFrame]:
        """The rows of ``out`` with the statistics of the windows that end at ``spots``, in parts."""
        for k in range(0, len(out["y"]), PACK):
            part = {name: column[k : k + PACK] for name, column in out.items()}
            if self.windows:
                at = spots[k : k + PACK]
                for name, fn, width in ROLLING_FEATURES:
                    options = {"ddof": 1} if fn == "std" else {}
                    part[name] = getattr(_windows_at(padded, at, width), fn)(axis=1, **options)
                part["history"] = list(_windows_at(padded, at, self.history))
            yield pd.DataFrame(part)


def _windows_at(values: np.ndarray, ends: np.ndarray, width: int) -> np.ndarray:
    """The ``width`` values that end at each place."""
    return np.lib.stride_tricks.sliding_window_view(values, width)[ends - width + 1]


def _with_state(updates: DataFrame, processor: StatefulProcessor, schema: str) -> DataFrame:
    """``processor`` over groups of series. State tables need the RocksDB store, which this sets for the session."""
    conf = updates.sparkSession.conf
    conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    # A batch stores what it changed and not the whole tables.
    conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
    group = F.pmod(F.xxhash64(SERIES), F.lit(GROUPS)).cast("int")
    return updates.withColumn("_group", group).groupBy("_group").transformWithStateInPandas(processor, schema, "append", "eventTime")


def detect_arrivals_stream(
    updates: DataFrame, jump: float = Config.eta_jump, idle: str | None = None
) -> DataFrame:
    """Each ETA observation that the watermark has passed, with ``arrival``.

    State: the last ETA, its time, and the held observations. After ``idle`` without an
    observation a series starts anew: its state goes, and the next one is compared with nothing.
    By default none does.
    """
    return _with_state(updates, _Detect(idle, jump), f"{SERIES} string, ts timestamp, eta double, arrival boolean")


def stream_features(
    updates: DataFrame,
    history: int = Config.lookback,
    min_gap: float = Config.min_gap,
    jump: float = Config.eta_jump,
    idle: str | None = None,
) -> DataFrame:
    """One row per kept headway: time, headway, rolling statistics, padded history.

    Detection, accumulation, the headway rule, padding and rolling run in one stateful
    step: last ETA, last arrival, the last gaps and the held observations are the state.
    A short history is padded in front with its earliest gap.
    """
    stats = ", ".join(f"{name} double" for name, _, _ in ROLLING_FEATURES)
    schema = f"{SERIES} string, ds timestamp, y double, {stats}, history array<double>"
    return _with_state(updates, _Features(history, min_gap, jump, idle), schema)


def stream_headways(updates: DataFrame, **options) -> DataFrame:
    """series_id, ``ds``, ``y``: kept headways as they finish, without the windows of ``stream_features``."""
    chosen = {"history": Config.lookback, "min_gap": Config.min_gap, "jump": Config.eta_jump, "idle": None} | options
    return _with_state(updates, _Features(**chosen, windows=False), f"{SERIES} string, ds timestamp, y double")


def with_future_row(
    features: DataFrame, weather: DataFrame | None = None, freq: str = Config.frequency, tz: str = "UTC"
) -> DataFrame:
    """The row to be predicted beside each feature row: time, calendar and weather.

    Weather is a static side, joined on the nearest hour, filled forward as in the batch form.
    """
    ahead = features.withColumn("future_ds", F.col("ds") + F.expr(f"INTERVAL {freq}"))
    ahead = ahead.withColumn("dow", weekend_flag("future_ds"))
    if weather is None:
        return ahead
    hours = filled_hours(weather, tz)
    return join_filled(ahead.withColumn("weather_hour", round_hour("future_ds")), hours).drop("weather_hour")


def score_stream(
    features: DataFrame, model, columns: list[str] | None = None, poll_time: Column | None = None
) -> DataFrame:
    """Live forecasts of the next headway: ``yhat`` and the minutes that remain at the poll time, by default now."""
    scored = score(features, model, "yhat", columns)
    now = F.current_timestamp() if poll_time is None else poll_time
    return live_columns(scored.withColumn("last_arrival", F.col("ds")), now)


def trip_durations_stream(
    origins: DataFrame, targets: DataFrame, limit: str = "2 hours", watermark: str = WATERMARK
) -> DataFrame:
    """``trip_id``, origin and target time, ``duration``: a stream-stream join.

    Both sides have ``trip_id`` and ``ts``, one arrival per trip and stop.
    """
    o = origins.select(F.col("trip_id"), F.col("ts").alias("origin_ts")).withWatermark("origin_ts", watermark)
    t = targets.select(F.col("trip_id").alias("_trip"), F.col("ts").alias("target_ts")).withWatermark(
        "target_ts", watermark
    )
    within = (F.col("target_ts") >= F.col("origin_ts")) & (
        F.col("target_ts") <= F.col("origin_ts") + F.expr(f"INTERVAL {limit}")
    )
    joined = o.join(t, (F.col("trip_id") == F.col("_trip")) & within).drop("_trip")
    return joined.withColumn("duration", minutes_between("origin_ts", "target_ts"))


def run_available(stream: DataFrame, name: str) -> DataFrame:
    """Run a stream over all data there is and return its output table.

    ``drop_stored`` deletes the output, so call it when no such stream runs; the checkpoint stays.
    """
    spark: SparkSession = stream.sparkSession
    path, checkpoint = new_path(spark, name), new_path(spark, f"{name}-checkpoint", owned=False)
    query = (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(T.StructType(stream.schema.fields)).parquet(path)


def freshness(query) -> dict[str, Any]:
    """Lag of a running query from its last progress: watermark, rows, rows dropped as late."""
    progress = query.lastProgress or {}
    late = sum(s.get("numRowsDroppedByWatermark", 0) for s in progress.get("stateOperators", []))
    return {
        "watermark": progress.get("eventTime", {}).get("watermark"),
        "latest_event": progress.get("eventTime", {}).get("max"),
        "input_rows": progress.get("numInputRows"),
        "late_rows": late,
    }
