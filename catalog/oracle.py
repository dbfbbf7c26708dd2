"""The same results in SQL, over the given tables alone."""

from __future__ import annotations

# Cleaned, numbered arrivals.
BASE = """
WITH arr AS (
  SELECT event_type AS series_id, ts AS ds, event_id AS tie, value AS duration,
         (epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 6e7 AS y
  FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)),
clean AS (
  SELECT series_id, ds, tie, duration, y,
         row_number() OVER (PARTITION BY series_id ORDER BY ds, tie) - 1 AS idx,
         count(*) OVER (PARTITION BY series_id) AS n
  FROM arr WHERE duration >= 0 AND duration <= 55 AND y <= 35)"""

SPLIT = (
    BASE
    + """,
parts AS (
  SELECT *, CASE WHEN idx < floor(0.6::DOUBLE * n) THEN 'train'
                 WHEN idx < floor(0.6::DOUBLE * n) + floor(0.2::DOUBLE * n) THEN 'val' ELSE 'test' END AS split
  FROM clean)"""
)

HOUR = "make_timestamp(CAST(round_even(epoch_us(ds) / 3.6e9, 0) AS BIGINT) * 3600000000)"

WEATHER = """,
wx AS (
  SELECT date_trunc('hour', ts) AS hour, max(value) AS temp, min(value) AS precip,
         CAST(count(value) AS DOUBLE) AS snow, max(value) - min(value) AS windspeed
  FROM events WHERE event_type = 'signup' GROUP BY 1)"""

WEATHER_COLUMNS = ("temp", "precip", "snow", "windspeed")


def _weather_rows(source: str = "clean", back: bool = True) -> str:
    """CTE ``wrows``: rows of ``source`` with weather filled forward (and back)."""
    past = "PARTITION BY series_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    ahead = "PARTITION BY series_id ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING"
    forward = ", ".join(f"last_value({c} IGNORE NULLS) OVER ({past}) AS {c}" for c in WEATHER_COLUMNS)
    both = ", ".join(f"coalesce({c}, first_value({c} IGNORE NULLS) OVER ({ahead})) AS {c}" for c in WEATHER_COLUMNS)
    plain = ", ".join(WEATHER_COLUMNS)
    return (
        WEATHER
        + f""",
wj AS (SELECT s.*, {plain} FROM {source} s LEFT JOIN wx ON wx.hour = {HOUR}),
wf AS (SELECT * EXCLUDE ({plain}), {forward} FROM wj),
wrows AS (SELECT * EXCLUDE ({plain}), {both if back else plain} FROM wf)"""
    )


def _full(fn: str, width: int, column: str = "y") -> str:
    frame = f"(PARTITION BY series_id ORDER BY idx ROWS BETWEEN {width - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({column}) OVER {frame} = {width} THEN {fn}({column}) OVER {frame} END"


def _back(column: str, order: str = "idx") -> str:
    frame = f"(PARTITION BY series_id ORDER BY {order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
    return f"first_value({column} IGNORE NULLS) OVER {frame}"


ROLLING = (
    ("rolling_std_50", "stddev_samp", 50),
    ("rolling_max_10", "max", 10),
    ("rolling_mean_10", "avg", 10),
    ("rolling_std_10", "stddev_samp", 10),
    ("rolling_mean_50", "avg", 50),
)


def _places(name: str) -> int:
    """Means of minute fractions tie at six places, not at nine; deviations carry noise."""
    return 6 if "std" in name else 9


def _shown(name: str) -> str:
    return _back(name) if "max" in name else f"round({_back(name)}, {_places(name)})"


FLAGSHIP = (
    BASE
    + _weather_rows()
    + ", rolled AS (SELECT *, "
    + ", ".join(f"{_full(fn, w)} AS {name}" for name, fn, w in ROLLING)
    + " FROM wrows) SELECT series_id, ds, duration, y, CAST(isodow(ds) >= 6 AS INTEGER) AS dow, "
    + ", ".join(WEATHER_COLUMNS)
    + ", "
    + ", ".join(f"{_shown(name)} AS {name}" for name, _, _ in ROLLING)
    + " FROM rolled"
)

EVENTS = "SELECT event_type AS series_id, ts AS arrival_date, event_id AS tie, value AS duration FROM events"

# The wall clock of New York for a UTC time.
NEW_YORK = "((ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York')"


def _quantiles(source: str, column: str) -> str:
    levels = "[0.0, 0.001, 0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99, 0.999, 1.0]::DOUBLE[]"
    plain = levels.replace("::DOUBLE[]", "")
    return f"""SELECT series_id, unnest({levels}) AS level,
      unnest([round(x, 9) for x in q]) AS quantile
      FROM (SELECT series_id, quantile_cont({column}, {plain}) AS q FROM {source} GROUP BY 1)"""


def _histogram(column: str, bins: int, shown: str) -> str:
    return (
        BASE
        + f""",
r AS (SELECT series_id, min({column}) AS lo, max({column}) AS hi, count({column}) AS n FROM clean GROUP BY 1),
c AS (SELECT c.series_id, CAST(least(floor((c.{column} - lo) / ((hi - lo) / {bins})), {bins - 1}) AS INTEGER) AS bin,
             count(*) AS k FROM clean c JOIN r USING (series_id) GROUP BY 1, 2)
SELECT r.series_id, CAST(b.bin AS INTEGER) AS bin, round(lo + b.bin * ((hi - lo) / {bins}), 9) AS lower,
       round(lo + (b.bin + 1) * ((hi - lo) / {bins}), 9) AS upper, {shown}
FROM r CROSS JOIN range(0, {bins}) AS b(bin) LEFT JOIN c ON c.series_id = r.series_id AND c.bin = b.bin"""
    )


def _kde(values: str, curve: bool, places: int) -> str:
    shown = f", round(coalesce(s.total, 0) / (n * h * sqrt(2 * pi())) * n * width, {places}) AS curve" if curve else ""
    return (
        BASE
        + f""",
nv AS (SELECT series_id, y, lag(y) OVER (PARTITION BY series_id ORDER BY idx) AS naive FROM clean),
v AS ({values}),
f AS (SELECT series_id, "column", count(*) AS n, pow(count(*), -0.2::DOUBLE) * stddev_samp(v) AS h, min(v) AS lo, max(v) AS hi,
             (max(v) - min(v)) / 30 AS width FROM v GROUP BY 1, 2),
e AS (SELECT series_id, min(lo) AS lo, max(hi) AS hi FROM f GROUP BY 1),
g AS (SELECT f.series_id, "column", f.n, f.h, f.width, p AS point,
             (e.lo - (e.hi - e.lo) * 0.1::DOUBLE) + p * ((e.hi + (e.hi - e.lo) * 0.1::DOUBLE) - (e.lo - (e.hi - e.lo) * 0.1::DOUBLE)) / 199 AS x
      FROM f JOIN e USING (series_id) CROSS JOIN range(0, 200) AS t(p)),
s AS (SELECT g.series_id, g."column", g.point, sum(exp(-0.5::DOUBLE * ((g.x - v.v) / g.h) * ((g.x - v.v) / g.h))) AS total
      FROM g JOIN v ON v.series_id = g.series_id AND v."column" = g."column" GROUP BY 1, 2, 3)
SELECT g.series_id, g."column", CAST(g.point AS BIGINT) AS point, round(x, {places}) AS x,
       round(coalesce(s.total, 0) / (n * h * sqrt(2 * pi())), {places}) AS density{shown}
FROM g LEFT JOIN s ON s.series_id = g.series_id AND s."column" = g."column" AND s.point = g.point"""
    )


def _power(grid: str) -> str:
    """CTEs up to ``p(series_id, k, frequency, power)``; ``grid`` yields series_id, k, frequency."""
    return (
        BASE
        + f""",
fx AS (SELECT series_id, min(ds) AS t0, avg(y) AS m, (epoch_us(max(ds)) - epoch_us(min(ds))) / 8.64e10 AS span FROM clean GROUP BY 1),
xy AS (SELECT series_id, (epoch_us(ds) - epoch_us(t0)) / 8.64e10 AS t, y - m AS v FROM clean JOIN fx USING (series_id)),
gr AS ({grid}),
sm AS (SELECT series_id, k, frequency, avg(cos(a)) AS c, avg(sin(a)) AS s, avg(v * cos(a)) AS yc0, avg(v * sin(a)) AS ys0,
              avg(cos(a) * cos(a)) AS cc0, avg(cos(a) * sin(a)) AS cs0, avg(v * v) AS yy0, avg(v) AS y0
       FROM (SELECT gr.series_id, k, frequency, v, 2 * pi() * frequency * t AS a FROM xy JOIN gr USING (series_id)) GROUP BY 1, 2, 3),
ct AS (SELECT series_id, k, frequency, yy0 - y0 * y0 AS yy, yc0 - y0 * c AS yc, ys0 - y0 * s AS ys,
              cc0 - c * c AS cc, 1 - cc0 - s * s AS ss, cs0 - c * s AS cs FROM sm),
p AS (SELECT series_id, k, frequency, (ss * yc * yc + cc * ys * ys - 2 * cs * yc * ys) / (yy * (cc * ss - cs * cs)) AS power FROM ct)"""
    )


AUTO_GRID = """SELECT series_id, k, 1 / 365.25::DOUBLE + k * (1 / (5 * span)) AS frequency
  FROM fx, LATERAL (SELECT unnest(range(0, 1 + CAST(round_even((24.0::DOUBLE - 1 / 365.25::DOUBLE) / (1 / (5 * span)), 0) AS BIGINT))) AS k)"""

FORECAST = (
    BASE
    + """,
cv AS (
  SELECT *, lag(ds) OVER w AS cutoff, lag(y) OVER w AS naive,
         CASE WHEN idx >= 10 THEN avg(y) OVER (PARTITION BY series_id ORDER BY idx ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) END AS moving
  FROM clean WINDOW w AS (PARTITION BY series_id ORDER BY idx)),
fc AS (SELECT * FROM cv WHERE idx >= n - floor(0.2::DOUBLE * n) AND idx >= 1)"""
)


def _by_series(name: str, formula: str) -> str:
    return FORECAST + f" SELECT series_id, round(avg({formula}), 6) AS {name} FROM fc GROUP BY 1"


def _scores(models: tuple[str, ...]) -> str:
    metrics = {"mae": "avg(abs(y - {m}))", "rmse": "sqrt(avg((y - {m}) * (y - {m})))"}
    parts = [
        f"SELECT {key} AS series_id, '{m}' AS model, '{name}' AS metric, round({f.format(m=m)}, 6) AS value FROM fc {group}"
        for m in models
        for name, f in metrics.items()
        for key, group in (("series_id", "GROUP BY series_id"), ("'ALL'", ""))
    ]
    return FORECAST + " " + " UNION ALL ".join(parts)


WINDOWS = (
    SPLIT
    + """,
win AS (
  SELECT series_id, idx, n, idx - 23 AS start_idx, idx + 1 AS target_idx, ds, duration,
         lead(ds) OVER w AS target_ds, lead(y) OVER w AS target, y,
         CASE WHEN idx - 23 >= 0 AND idx < floor(0.6::DOUBLE * n) THEN 'train'
              WHEN idx - 23 >= floor(0.6::DOUBLE * n) AND idx < floor(0.6::DOUBLE * n) + floor(0.2::DOUBLE * n) THEN 'val'
              WHEN idx - 23 >= floor(0.6::DOUBLE * n) + floor(0.2::DOUBLE * n) THEN 'test' END AS split
  FROM clean WINDOW w AS (PARTITION BY series_id ORDER BY idx)),
windows AS (SELECT * FROM win WHERE split IS NOT NULL AND idx < n - 24)"""
)

SEASONAL = (
    SPLIT
    + """,
q AS (SELECT series_id, isodow(ds) >= 6 AS we, hour(ds) AS hr, quantile_cont(y, [0.1, 0.5, 0.9]) AS q
      FROM parts WHERE split = 'train' GROUP BY 1, 2, 3),
g AS (SELECT series_id, quantile_cont(y, [0.1, 0.5, 0.9]) AS g FROM parts WHERE split = 'train' GROUP BY 1),
sf AS (SELECT p.series_id, p.idx, p.y, coalesce(q[1], g[1]) AS lo80, coalesce(q[2], g[2]) AS yhat, coalesce(q[3], g[3]) AS hi80
       FROM parts p LEFT JOIN q ON q.series_id = p.series_id AND q.we = (isodow(p.ds) >= 6) AND q.hr = hour(p.ds)
       JOIN g ON g.series_id = p.series_id WHERE split = 'test')"""
)

SCALER = (
    SPLIT
    + """,
sc AS (SELECT series_id, avg(duration) AS dm, stddev_pop(duration) AS dsd, avg(y) AS ym, stddev_pop(y) AS ysd
       FROM parts WHERE split = 'train' GROUP BY 1)"""
)

MESSAGES = """SELECT CAST(user_id AS VARCHAR) AS target, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS "timestamp", value AS eta FROM events"""

# Arrivals seen in the ETAs of a user, and the gaps between them.
DETECTED = """
WITH obs AS (
  SELECT CAST(user_id AS VARCHAR) AS series_id, event_id, ts, value AS eta,
         coalesce(value > lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) + 3.0, false) AS arrival
  FROM events)"""

GAPS = (
    DETECTED
    + """,
gaps AS (SELECT series_id, ts AS ds, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY series_id ORDER BY ts))) / 6e7 AS y
         FROM obs WHERE arrival),
kept AS (SELECT * FROM gaps WHERE y >= 1)"""
)

# A stream gives what the watermark has passed: all but the last two minutes, in whole milliseconds.
PASSED = "(SELECT (epoch_us(max(ts)) // 1000 - 120000) * 1000 FROM events)"
STREAM_GAPS = GAPS.replace("FROM obs WHERE arrival", f"FROM obs WHERE arrival AND epoch_us(ts) <= {PASSED}")


def _padded(width: int) -> str:
    """The last ``width`` gaps, with the earliest one repeated in front if there are fewer."""
    rows = f"list(y) OVER (PARTITION BY series_id ORDER BY ds ROWS BETWEEN {width - 1} PRECEDING AND CURRENT ROW)"
    return f"list_concat([first(y) OVER (PARTITION BY series_id ORDER BY ds) for x in range({width} - len({rows}))], {rows})"


def _huber(rounds: int = 10, lags: int = 12, delta: float = 1.0, ridge: float = 1e-3) -> str:
    """CTEs up to ``hu(series_id, idx, n, ds, y, split, naive, huber)``: reweighted least squares, one CTE a round.

    The equations of a round are a list of rows, solved by elimination in a list_reduce whose
    further elements are the numbers of the pivots.
    """
    last = ("rolling_mean_10", "rolling_std_10", "rolling_mean_50", "rolling_std_50", "rolling_max_10", "duration")
    taken = [f"lag(y, {k}) OVER w" for k in range(1, lags + 1)] + [f"lag({c}) OVER w" for c in last] + ["dow"]
    size = len(taken)
    x, z = [f"x{i}" for i in range(size)], ["1", *[f"z{i}" for i in range(size)]]
    middle = ", ".join(f"avg({c}) AS m{i}, CASE WHEN stddev_pop({c}) > 0 THEN stddev_pop({c}) ELSE 1 END AS s{i}" for i, c in enumerate(x))
    known = " AND ".join(f"{c} IS NOT NULL" for c in x)
    rolled = ", ".join(f"{_back(name)} AS {name}" for name, _, _ in ROLLING)
    text = (
        SPLIT
        + ", hr AS (SELECT *, "
        + ", ".join(f"{_full(fn, w)} AS {name}" for name, fn, w in ROLLING)
        + f""" FROM parts),
hb AS (SELECT series_id, idx, n, ds, y, split, duration, CAST(isodow(ds) >= 6 AS INTEGER) AS dow, {rolled} FROM hr),
hx AS (SELECT series_id, idx, n, ds, y, split, {', '.join(f'CAST({t} AS DOUBLE) AS x{i}' for i, t in enumerate(taken))}
       FROM hb WINDOW w AS (PARTITION BY series_id ORDER BY idx)),
hf AS MATERIALIZED (SELECT * FROM hx WHERE idx >= {lags} AND {known}),
hm AS (SELECT {middle} FROM hf WHERE split = 'train'),
hz AS MATERIALIZED (SELECT series_id, idx, n, ds, y, split, x0 AS naive, {', '.join(f'(x{i} - m{i}) / s{i} AS z{i}' for i in range(size))} FROM hf, hm)"""
    )
    fitted = lambda r: " + ".join(f"b{r}[{i + 1}] * {c}" for i, c in enumerate(z))
    for r in range(1, rounds + 1):
        weight = f"1 / greatest(1.0, abs(y - ({fitted(r - 1)})) / {delta})" if r > 1 else "1.0::DOUBLE"
        source = f"hz, hs{r - 1}" if r > 1 else "hz"
        sums = [f"sum(w * {a} * {b}) AS g{i}_{j}" for i, a in enumerate(z) for j, b in enumerate([*z, "y"]) if j >= i]
        entry = lambda i, j: f"g{min(i, j)}_{max(i, j)}" + (f" + {ridge}::DOUBLE * g0_0" if i == j > 0 else "")
        matrix = "[" + ", ".join("[" + ", ".join(entry(i, j) for j in range(size + 2)) + "]" for i in range(size + 1)) + "]"
        pivots = ", ".join(f"[[{p}.0::DOUBLE]]" for p in range(1, size + 2))
        step = """lambda m, p: list_transform(m, lambda q, i: CASE WHEN i = p[1][1] THEN list_transform(q, lambda v: v / q[i])
            ELSE list_transform(q, lambda v, j: v - q[CAST(p[1][1] AS INTEGER)] * m[CAST(p[1][1] AS INTEGER)][j] / m[CAST(p[1][1] AS INTEGER)][CAST(p[1][1] AS INTEGER)]) END)"""
        text += f""",
hg{r} AS MATERIALIZED (SELECT {', '.join(sums)} FROM (SELECT *, {weight} AS w FROM {source} WHERE split = 'train')),
hs{r} AS MATERIALIZED (SELECT list_transform(list_reduce([{matrix}, {pivots}], {step}), lambda q: q[{size + 2}]) AS b{r} FROM hg{r})"""
    return text + f""",
hu AS (SELECT series_id, idx, n, ds, y, split, naive, {fitted(rounds)} AS huber FROM hz, hs{rounds})"""


DECEMBER = "TIMESTAMP '2024-01-31 00:00:00'"


def statements() -> dict[str, str]:
    sql: dict[str, str] = {"flagship_features": FLAGSHIP}

    sql["extract_arrivals"] = (
        "SELECT event_type AS series_id, ts AS arrival_date, value AS duration, CAST(isodow(ts) - 1 AS INTEGER) AS dow FROM events"
    )
    sql["clean_arrivals"] = BASE + " SELECT series_id, idx, n, ds, duration, y FROM clean"
    sql["clean_report"] = (
        BASE
        + """, c AS (SELECT count(*) AS c0, count(*) FILTER (WHERE duration >= 0) AS c1,
             count(*) FILTER (WHERE duration >= 0 AND duration <= 55) AS c2,
             count(*) FILTER (WHERE duration >= 0 AND duration <= 55 AND y <= 35) AS c3,
             count(*) FILTER (WHERE duration >= 0 AND duration <= 55 AND y <= 35 AND ds >= TIMESTAMP '2024-01-01') AS c4 FROM arr)
        SELECT 1::INTEGER AS step, 'duration_min' AS rule, c0 AS rows_before, c1 AS rows_after, c0 - c1 AS removed FROM c
        UNION ALL SELECT 2, 'duration_max', c1, c2, c1 - c2 FROM c
        UNION ALL SELECT 3, 'headway_max', c2, c3, c2 - c3 FROM c
        UNION ALL SELECT 4, 'weather_range', c3, c4, c3 - c4 FROM c"""
    )
    sql["clean_report_observed"] = sql["clean_report"]
    sql["stream_clean_report"] = sql["clean_report"]
    sql["drop_nulls"] = BASE + " SELECT series_id, ds AS arrival_date, duration, y AS mbt FROM arr WHERE y IS NOT NULL AND duration IS NOT NULL"
    sql["year_filter"] = "SELECT event_type AS series_id, ts AS arrival_date, value AS duration FROM events WHERE year(ts) IN (2024, 2025)"
    sql["date_floor_filter"] = (
        "SELECT event_type AS series_id, ts AS arrival_date, value AS duration FROM events WHERE ts >= TIMESTAMP '2024-01-15'"
    )
    sql["weekend"] = "SELECT event_id AS tie, CAST(isodow(ts) >= 6 AS INTEGER) AS dow FROM events"
    sql["calendar"] = f"""SELECT event_id AS tie, CAST(hour({NEW_YORK}) AS INTEGER) AS hour, dayname({NEW_YORK}) AS day_name,
        CAST(year({NEW_YORK}) AS INTEGER) AS year, strftime({NEW_YORK}, '%Y-%m') AS month FROM events"""
    sql["local_time"] = f"SELECT event_id AS tie, {NEW_YORK} AS local FROM events"
    sql["parse_times"] = "SELECT event_id AS tie, ts AS parsed, ts AS wall FROM events"
    sql["default_duration"] = """SELECT 'given' AS source, event_id AS tie, CASE WHEN value <= 55 THEN value ELSE 0.0 END AS duration FROM events
        UNION ALL SELECT 'absent', event_id, 0.0 FROM events"""
    sql["split_columns"] = BASE + " SELECT duration, y AS mbt, tie, y AS target, true AS by_name FROM arr"
    sql["fill_zero"] = BASE + " SELECT series_id, tie, coalesce(y, 0.0) AS mbt FROM arr"

    sql["rounded_hours"] = f"SELECT tie, {HOUR} AS hour FROM (SELECT event_id AS tie, ts AS ds FROM events)"
    sql["time_arithmetic"] = """SELECT event_id AS tie, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 8.64e10 AS days,
        make_timestamp(epoch_us(ts) + CAST(round_even(value * 6e7, 0) AS BIGINT)) AS later FROM events"""
    sql["time_texts"] = """SELECT event_id AS tie, strftime(ts, '%Y-%m-%d %H:%M') AS label,
        event_type || '#' || strftime(ts, '%Y-%m-%dT%H:%M:00') AS row_key, printf('%.4f', value) AS four_places, value AS parsed FROM events"""
    sql["cyclical_features"] = """SELECT event_id AS tie,
        round(sin(epoch_us(ts) / 1e6 * (2 * pi() / 86400)), 7) + 0.0 AS day_sin, round(cos(epoch_us(ts) / 1e6 * (2 * pi() / 86400)), 7) + 0.0 AS day_cos,
        round(sin(epoch_us(ts) / 1e6 * (2 * pi() / 604800)), 7) + 0.0 AS week_sin, round(cos(epoch_us(ts) / 1e6 * (2 * pi() / 604800)), 7) + 0.0 AS week_cos
        FROM events"""
    sql["cyclical_calendar"] = """SELECT event_id AS tie,
        round(sin(2 * pi() * (hour(ts) * 60 + minute(ts)) / 1440), 9) + 0.0 AS day_sin, round(cos(2 * pi() * (hour(ts) * 60 + minute(ts)) / 1440), 9) + 0.0 AS day_cos,
        round(sin(2 * pi() * (isodow(ts) - 1) * 1440 / 10080), 9) + 0.0 AS week_sin, round(cos(2 * pi() * (isodow(ts) - 1) * 1440 / 10080), 9) + 0.0 AS week_cos
        FROM events"""

    weather = "SELECT series_id, idx, temp, precip, snow, windspeed FROM wrows"
    sql["weather_join"] = BASE + _weather_rows() + " " + weather
    sql["weather_from_file"] = BASE + _weather_rows() + " SELECT series_id, idx, temp, precip, snow FROM wrows"
    sql["weather_join_forward_only"] = BASE + _weather_rows(back=False) + " " + weather
    sql["weather_asof"] = (
        BASE
        + WEATHER
        + """, known AS (SELECT hour, temp FROM wx), drops AS (SELECT hour, precip FROM wx WHERE snow > 1)
        SELECT series_id, idx, known.temp, drops.precip FROM clean
        ASOF LEFT JOIN known ON clean.ds >= known.hour ASOF LEFT JOIN drops ON clean.ds >= drops.hour"""
    )
    sql["last_value_by_user"] = """SELECT e.event_id, k.value FROM events e
        ASOF LEFT JOIN (SELECT user_id, ts, value FROM events WHERE event_type <> 'view') k ON e.user_id = k.user_id AND e.ts >= k.ts"""
    gappy = BASE + ", g AS (SELECT *, CASE WHEN duration <= 20 THEN duration END AS k FROM clean)"
    sql["forward_fill"] = (
        gappy + " SELECT series_id, tie, last_value(k IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY idx) AS known FROM g"
    )
    sql["backward_fill"] = gappy + f" SELECT series_id, tie, {_back('k')} AS known FROM g"
    sql["rolling_back_filled_with_gaps"] = (
        gappy
        + f", r AS (SELECT *, {_full('avg', 3, 'k')} AS rmean, {_full('max', 3, 'k')} AS rmax FROM g)"
        + f" SELECT series_id, idx, round({_back('rmean')}, 9) AS rolling_mean_3, {_back('rmax')} AS rolling_max_3 FROM r"
    )
    sql["monthly_static"] = (
        BASE
        + """, m AS (SELECT strftime(ts, '%Y-%m') AS month_id, count(*) AS cause_count FROM events WHERE event_type = 'error' GROUP BY 1)
        SELECT series_id, idx, strftime(ds, '%Y-%m') AS month_id, cause_count FROM clean LEFT JOIN m ON m.month_id = strftime(ds, '%Y-%m')"""
    )

    for name, fn, width in ROLLING:
        sql[name] = BASE + f", r AS (SELECT *, {_full(fn, width)} AS v FROM clean) SELECT series_id, idx, round({_back('v')}, {_places(name)}) AS {name} FROM r"
    sql["rolling_plain_50"] = BASE + f" SELECT series_id, idx, round({_full('avg', 50)}, 9) AS rolling_mean_50 FROM clean"
    gaps = BASE + """, g AS (SELECT series_id, ds, y, row_number() OVER (PARTITION BY series_id ORDER BY ds, tie) - 1 AS idx,
        count(*) OVER (PARTITION BY series_id) AS n FROM arr WHERE y >= 1)"""
    sql["headways_last_150"] = gaps + " SELECT series_id, ds, y FROM g WHERE idx >= n - 150"
    sql["headways_all"] = gaps + " SELECT series_id, idx, n, ds, y FROM g"
    sql["naive"] = BASE + " SELECT series_id, idx, y, lag(y) OVER (PARTITION BY series_id ORDER BY idx) AS naive FROM clean"
    sql["split_60_20_20"] = SPLIT + " SELECT series_id, idx, split FROM parts"
    sql["split_50_25_25"] = (
        BASE
        + """ SELECT series_id, idx, CASE WHEN idx < floor(0.5::DOUBLE * n) THEN 'train'
        WHEN idx < floor(0.5::DOUBLE * n) + floor(0.25::DOUBLE * n) THEN 'val' ELSE 'test' END AS split FROM clean"""
    )
    sql["history_future_split"] = BASE + " SELECT series_id, idx, CASE WHEN idx >= n - 3 THEN 'future' ELSE 'history' END AS part FROM clean"
    sql["pad_history"] = (
        BASE
        + """ SELECT series_id, idx - n + 160 AS step, false AS is_pad, ds, y FROM clean WHERE idx >= n - 160
        UNION ALL SELECT series_id, k AS step, true, ds, y FROM clean, LATERAL (SELECT unnest(range(0, 160 - n)) AS k) WHERE idx = 0 AND n < 160"""
    )
    sql["pad_short_history"] = """WITH u AS (SELECT user_id, value, row_number() OVER w - 1 AS idx, count(*) OVER (PARTITION BY user_id) AS n
        FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
        SELECT user_id, idx - n + 100 AS step, false AS is_pad, value FROM u WHERE idx >= n - 100
        UNION ALL SELECT user_id, k, true, value FROM u, LATERAL (SELECT unnest(range(0, 100 - n)) AS k) WHERE idx = 0 AND n < 100"""
    sql["append_future_row"] = (
        BASE
        + """, f AS (SELECT series_id, idx, n, ds, y, false AS is_future FROM clean
        UNION ALL SELECT series_id, idx + 1, n, ds + INTERVAL 1 HOUR, NULL, true FROM clean WHERE idx = n - 1)"""
        + _weather_rows("f")
        + " SELECT series_id, idx, ds, y, is_future, temp, CAST(isodow(ds) >= 6 AS INTEGER) AS dow FROM wrows"
    )
    sql["align_future"] = (
        BASE
        + """, h AS (SELECT series_id, max(ds) AS last FROM clean WHERE idx < n - 2 GROUP BY 1)
        SELECT c.series_id, idx, last + INTERVAL 1 HOUR * (idx - n + 3) AS ds, CAST(idx - n + 3 AS INTEGER) AS step, true AS aligned
        FROM clean c JOIN h USING (series_id) WHERE idx >= n - 2"""
    )

    sql["tail_200"] = BASE + " SELECT series_id, idx, ds, y FROM clean WHERE idx >= n - 200"
    sql["head_165"] = BASE + " SELECT series_id, idx, ds, y FROM clean WHERE idx < 165"
    sql["latest_100"] = "SELECT event_type AS series_id, event_id AS tie, ts AS arrival_date FROM events ORDER BY ts DESC, event_id DESC LIMIT 100"
    sql["slice_175"] = BASE + " SELECT series_id, idx, y FROM clean WHERE idx >= 0 AND idx < 175"
    sql["slice_ticks"] = (
        BASE
        + """, t AS (SELECT CAST(k AS INTEGER) AS tick, (k * 174) // 7 AS at FROM range(0, 8) AS r(k))
        SELECT series_id, idx, tick, strftime(ds, '%Y-%m-%d %H:%M') AS label FROM clean JOIN t ON t.at = clean.idx"""
    )
    sql["sorted_series"] = BASE + " SELECT series_id, idx, ds FROM clean ORDER BY series_id, ds, tie"

    sql["quantiles_11"] = BASE + " " + _quantiles("clean", "y")
    sql["quantiles_11_duration"] = BASE + " " + _quantiles("(SELECT event_type AS series_id, value FROM events)", "value")
    described = """SELECT series_id, '{c}' AS "column", count({c}) AS count, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, min({c}) AS min,
        round(quantile_cont({c}, 0.25), 6) AS q25, round(quantile_cont({c}, 0.5), 6) AS q50, round(quantile_cont({c}, 0.75), 6) AS q75, max({c}) AS max
        FROM clean GROUP BY 1"""
    sql["describe"] = BASE + " " + " UNION ALL ".join(described.format(c=c) for c in ("duration", "y"))
    local = NEW_YORK.replace("ts", "ds", 1)
    sql["hourly_means"] = (
        BASE + f" SELECT CAST(hour({local}) AS INTEGER) AS hour, dayname({local}) AS day_name, round(avg(y), 6) AS mean FROM clean GROUP BY 1, 2"
    )
    days = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")
    sql["heatmap"] = (
        BASE
        + " SELECT CAST(hour(ds) AS INTEGER) AS hour, "
        + ", ".join(f'round(avg(y) FILTER (WHERE dayname(ds) = \'{d}\'), 6) AS "{d}"' for d in days)
        + " FROM clean GROUP BY 1"
    )
    for bins in (10, 30, 50):
        sql[f"histogram_{bins}"] = _histogram("y", bins, "coalesce(c.k, 0) AS count")
    sql["histogram_density"] = _histogram("duration", 30, "round(coalesce(c.k, 0) / (r.n * ((hi - lo) / 30)), 9) AS density")
    both = """SELECT series_id, 'y' AS "column", y AS v FROM nv UNION ALL SELECT series_id, 'naive', naive FROM nv WHERE naive IS NOT NULL"""
    sql["kde_200"] = _kde(both, curve=False, places=9)
    sql["kde_residuals"] = _kde("""SELECT series_id, 'error' AS "column", y - naive AS v FROM nv WHERE naive IS NOT NULL""", curve=True, places=6)
    sql["row_count"] = "SELECT event_type, count(*) AS rows FROM events GROUP BY 1"
    sql["frame_shape"] = "SELECT count(*) AS rows, CAST(6 AS INTEGER) AS columns FROM events"

    regular = "SELECT series_id, k, 0.05::DOUBLE + k * 0.05::DOUBLE AS frequency FROM fx CROSS JOIN range(0, 200) AS r(k)"
    shown = "SELECT series_id, round(frequency, 6) AS frequency, round(power, 6) AS power FROM p"
    sql["periodogram"] = _power(regular) + " " + shown
    sql["autopower"] = _power(AUTO_GRID) + " " + shown
    sql["spectral_peaks"] = (
        _power(AUTO_GRID)
        + """, l AS (SELECT *, coalesce(lag(power) OVER w, -1) AS before, coalesce(lead(power) OVER w, -1) AS behind FROM p
                     WINDOW w AS (PARTITION BY series_id ORDER BY k)),
        t AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY power DESC) AS rank FROM l WHERE power > before AND power > behind)
        SELECT series_id, round(frequency, 6) AS frequency, round(power, 6) AS power, CAST(rank AS INTEGER) AS rank,
               round(frequency * 365.25::DOUBLE, 6) AS per_year, round(1 / frequency, 6) AS period_days FROM t WHERE rank <= 3"""
    )

    sql["scaler"] = (
        SCALER
        + """ SELECT series_id, 'duration' AS feature, round(dm, 6) AS mean, round(dsd, 6) AS std FROM sc
        UNION ALL SELECT series_id, 'y', round(ym, 6), round(ysd, 6) FROM sc"""
    )
    sql["standard_scale"] = (
        SCALER + " SELECT series_id, idx, round((duration - dm) / dsd, 6) AS duration, round((y - ym) / ysd, 6) AS y FROM parts JOIN sc USING (series_id)"
    )
    sql["scaler_reloaded"] = sql["standard_scale"]
    sql["inverse_scale"] = BASE + " SELECT series_id, idx, round(duration, 9) AS duration, round(y, 9) AS y FROM clean"
    sql["robust_scale"] = (
        SPLIT
        + """, m AS (SELECT series_id, quantile_cont(duration, 0.5) AS dm, quantile_cont(y, 0.5) AS ym FROM parts WHERE split = 'train' GROUP BY 1),
        a AS (SELECT series_id, quantile_cont(abs(duration - dm), 0.5) AS da, quantile_cont(abs(y - ym), 0.5) AS ya
              FROM parts JOIN m USING (series_id) WHERE split = 'train' GROUP BY 1)
        SELECT series_id, idx, round((duration - dm) / da, 6) AS duration, round((y - ym) / ya, 6) AS y
        FROM parts JOIN m USING (series_id) JOIN a USING (series_id)"""
    )
    sql["make_windows"] = (
        WINDOWS
        + """ SELECT w.series_id, w.split, w.start_idx, w.target_idx, w.target_ds, w.target, CAST(c.idx - w.start_idx AS INTEGER) AS step, c.duration, c.y
        FROM windows w JOIN clean c ON c.series_id = w.series_id AND c.idx BETWEEN w.start_idx AND w.idx"""
    )
    sql["test_windows_reloaded"] = (
        WINDOWS
        + """ SELECT w.series_id, w.split, w.start_idx, w.target, c.y AS first_y FROM windows w
        JOIN clean c ON c.series_id = w.series_id AND c.idx = w.start_idx WHERE w.split = 'test'"""
    )
    sql["shuffled_batches"] = (
        WINDOWS
        + """, t AS (SELECT count(*) AS total FROM windows WHERE split = 'train')
        SELECT place // 256 AS batch, count(*) AS rows, min(place) AS first, max(place) AS last
        FROM t, LATERAL (SELECT unnest(range(0, total)) AS place) GROUP BY 1"""
    )
    sql["shuffled_members"] = WINDOWS + " SELECT series_id, start_idx, target FROM windows WHERE split = 'train'"
    sql["shuffle_order"] = (
        WINDOWS + " SELECT count(*) AS rows, count(*) AS places, 0 AS first, count(*) - 1 AS last, true AS moved FROM windows WHERE split = 'train'"
    )
    sql["ordered_batches"] = (
        WINDOWS
        + """, o AS (SELECT series_id, start_idx, row_number() OVER (ORDER BY series_id, start_idx) - 1 AS place FROM windows WHERE split IN ('val', 'test'))
        SELECT series_id, start_idx, place, place // 256 AS batch FROM o"""
    )
    sql["forecast_context"] = (
        WINDOWS
        + """, f AS (SELECT series_id, min(start_idx) AS first FROM windows WHERE split = 'test' GROUP BY 1)
        SELECT w.series_id, w.start_idx - f.first AS sample, w.target AS true_value, w.y AS prediction, abs(w.target - w.y) AS abs_error,
               CAST(c.idx - w.start_idx AS INTEGER) AS step, round(c.y, 9) AS history
        FROM windows w JOIN f USING (series_id) JOIN clean c ON c.series_id = w.series_id AND c.idx BETWEEN w.start_idx AND w.idx
        WHERE w.split = 'test' AND w.start_idx < f.first + 3"""
    )

    sql["rolling_origin_cv"] = FORECAST + " SELECT series_id, idx, cutoff, ds, CAST(1 AS INTEGER) AS ahead, y, naive FROM fc"
    sql["rolling_origin_three_ahead"] = (
        BASE
        + """, o AS (SELECT c.*, k AS ahead, idx - k AS cutoff_idx, n - CAST(floor(0.2::DOUBLE * n) AS BIGINT) - 1 AS start FROM clean c CROSS JOIN range(1, 4) AS r(k))
        SELECT o.series_id, o.idx, h.ds AS cutoff, o.cutoff_idx, CAST(ahead AS INTEGER) AS ahead, o.ds, o.y
        FROM o JOIN clean h ON h.series_id = o.series_id AND h.idx = o.cutoff_idx
        WHERE o.idx > o.start AND o.cutoff_idx >= start AND (o.cutoff_idx - start) % 2 = 0 AND o.cutoff_idx + 3 <= o.n - 1"""
    )
    sql["mae"] = _by_series("mae", "abs(y - naive)")
    sql["rmse"] = FORECAST + " SELECT series_id, round(sqrt(avg((y - naive) * (y - naive))), 6) AS rmse FROM fc GROUP BY 1"
    sql["huber"] = _by_series(
        "huber", "CASE WHEN abs(y - naive) <= 1 THEN (y - naive) * (y - naive) * 0.5::DOUBLE ELSE abs(y - naive) - 0.5::DOUBLE END"
    )
    for level, name in ((0.1, "pinball_10"), (0.5, "pinball_50"), (0.9, "pinball_90")):
        sql[name] = _by_series(name, f"greatest((y - naive) * {level}::DOUBLE, (y - naive) * ({level}::DOUBLE - 1))")
    sql["evaluate"] = _scores(("naive", "moving"))
    sql["compare_models"] = FORECAST + " " + " UNION ALL ".join(
        f"SELECT '{m}' AS model, round(avg(abs(y - {m})), 6) AS mae, round(sqrt(avg((y - {m}) * (y - {m}))), 6) AS rmse FROM fc"
        for m in ("naive", "moving")
    )
    sql["metrics_json"] = (
        _scores(("naive",)).replace("SELECT series_id AS series_id, 'naive' AS model, 'mae'", "SELECT * FROM (SELECT series_id AS series_id, 'naive' AS model, 'mae'", 1)
        + ")"
    ).replace(" SELECT * FROM (", " SELECT series_id, model, metric AS name, value AS \"numberValue\", 'RAW' AS format FROM (", 1)
    sql["residual_frame"] = (
        FORECAST + ' SELECT series_id, idx, y AS "Actual", naive AS "Predicted", y - naive AS "Error", abs(y - naive) AS "Abs Error" FROM fc'
    )
    sql["naive_mae"] = WINDOWS + " SELECT series_id, split, round(avg(abs(target - y)), 6) AS mae FROM windows GROUP BY 1, 2"
    sql["target_dates"] = WINDOWS + " SELECT series_id, target_idx, target_ds, target FROM windows WHERE split = 'test'"

    sql["seasonal_quantile_forecast"] = (
        SEASONAL + " SELECT series_id, idx, round(lo80, 6) AS lo80, round(yhat, 6) AS yhat, round(hi80, 6) AS hi80 FROM sf"
    )
    sql["coverage"] = (
        SEASONAL
        + """ SELECT series_id, count(*) AS rows, round(avg(CASE WHEN y BETWEEN lo80 AND hi80 THEN 1.0::DOUBLE ELSE 0 END), 6) AS coverage,
        round(avg(hi80 - lo80), 6) AS mean_width FROM sf GROUP BY 1"""
    )
    sql["residual_band"] = (
        SPLIT
        + """, nv AS (SELECT *, lag(y) OVER (PARTITION BY series_id ORDER BY idx) AS naive FROM parts),
        r AS (SELECT series_id, quantile_cont(y - naive, [0.1, 0.9]) AS q FROM nv WHERE split = 'val' GROUP BY 1)
        SELECT series_id, idx, round(naive + q[1], 6) AS lo80, round(naive + q[2], 6) AS hi80 FROM nv JOIN r USING (series_id) WHERE split = 'test'"""
    )
    sql["best_by_validation"] = (
        SPLIT
        + """, f AS (SELECT *, lag(y) OVER w AS naive,
            CASE WHEN idx >= 10 THEN avg(y) OVER (PARTITION BY series_id ORDER BY idx ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) END AS moving
            FROM parts WINDOW w AS (PARTITION BY series_id ORDER BY idx)),
        l AS (SELECT series_id, avg(abs(y - naive)) AS a, avg(abs(y - moving)) AS b FROM f WHERE split = 'val' GROUP BY 1)
        SELECT series_id, CASE WHEN b IS NULL OR a <= b THEN 'naive' ELSE 'moving' END AS best, round(least(a, b), 6) AS loss FROM l"""
    )

    sql["huber_regression"] = _huber() + " SELECT series_id, idx, y, round(huber, 5) AS huber FROM hu WHERE split = 'test'"
    scored = " UNION ALL ".join(
        f"SELECT {key} AS series_id, '{m}' AS model, '{name}' AS metric, round({f.format(m=m)}, 6) AS value FROM tt {group}"
        for m in ("naive", "seasonal", "huber")
        for name, f in (("mae", "avg(abs(y - {m}))"), ("rmse", "sqrt(avg((y - {m}) * (y - {m})))"))
        for key, group in (("series_id", "GROUP BY series_id"), ("'ALL'", ""))
    )
    sql["training_run"] = (
        _huber()
        + """,
        tq AS (SELECT series_id, isodow(ds) >= 6 AS we, hour(ds) AS hr, quantile_cont(y, 0.5) AS q FROM hu WHERE split = 'train' GROUP BY 1, 2, 3),
        tg AS (SELECT series_id, quantile_cont(y, 0.5) AS g FROM hu WHERE split = 'train' GROUP BY 1),
        tt AS (SELECT h.series_id, h.y, h.naive, h.huber, coalesce(q, g) AS seasonal FROM hu h JOIN tg USING (series_id)
               LEFT JOIN tq ON tq.series_id = h.series_id AND tq.we = (isodow(h.ds) >= 6) AND tq.hr = hour(h.ds)
               WHERE idx >= n - floor(0.2::DOUBLE * n)) """
        + scored
    )

    sql["csv_reloaded"] = BASE + " SELECT tie, ds AS arrival_date, duration, y AS mbt, CAST(isodow(ds) >= 6 AS INTEGER) AS dow FROM arr"
    sql["positional_reloaded"] = BASE + " SELECT CAST(tie AS DOUBLE) AS tie, duration, y AS target FROM clean"
    sql["stored_predictions"] = """SELECT event_type || '#' || event_id AS doc_id, strftime(ts, '%Y-%m-%d %H') AS time, event_type AS route,
        CAST(user_id AS VARCHAR) AS stop, value AS pred_mbt, 'ok' AS status, ts AS created FROM events ORDER BY ts DESC, doc_id LIMIT 100"""
    sql["prediction_store"] = """WITH v AS (
          SELECT event_type AS route, CAST(user_id AS VARCHAR) AS stop, strftime(ts, '%Y-%m-%d %H') AS time, ts, event_id, value AS v FROM events WHERE event_id % 2 = 0
          UNION ALL SELECT event_type, CAST(user_id AS VARCHAR), strftime(ts, '%Y-%m-%d %H'), ts, event_id, -1.0 FROM events WHERE event_id % 3 = 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY route, stop, time ORDER BY ts DESC, route || '#' || event_id DESC, v DESC) AS k FROM v)
        SELECT route || '#' || event_id AS doc_id, time, route, stop, v AS pred_mbt, 'ok' AS status, ts + INTERVAL 1 HOUR AS created FROM r WHERE k = 1"""
    sql["latest_predictions"] = """SELECT event_type AS route_id, strftime(ts, '%Y-%m-%d %H') AS timestamp_str,
        event_type || '#' || arg_max(event_id, ts) AS doc_id, arg_max(value, ts) AS predicted_mbt FROM events GROUP BY event_type, user_id, 2"""

    sql["parse_messages"] = MESSAGES
    sql["parse_messages_for_targets"] = MESSAGES + " WHERE user_id IN (SELECT user_id FROM events WHERE event_type = 'error')"
    sql["station_filter"] = """SELECT event_id, CASE WHEN event_id % 2 = 0 THEN event_type END AS device_id,
        CASE WHEN event_id % 2 = 1 THEN event_type END AS station_id FROM events WHERE event_type IN ('view', 'purchase')"""
    sql["detect_arrivals"] = DETECTED + " SELECT series_id, event_id, ts, eta, arrival FROM obs"
    sql["trip_durations"] = """WITH t AS (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, min(ts) FILTER (WHERE event_type = 'view') AS origin_ts,
            min(ts) FILTER (WHERE event_type = 'purchase') AS target_ts FROM events GROUP BY 1, 2),
        d AS (SELECT *, (epoch_us(target_ts) - epoch_us(origin_ts)) / 6e7 AS duration FROM t)
        SELECT user_id, day, origin_ts, target_ts, duration FROM d WHERE duration BETWEEN 0 AND 120"""
    ends = BASE + ", e AS (SELECT series_id, ds AS last_arrival, y FROM clean WHERE idx = n - 1)"
    arriving = "make_timestamp(epoch_us(last_arrival) + CAST(round_even({} * 6e7, 0) AS BIGINT))"
    sql["eta_forecast"] = (
        ends
        + f""" SELECT series_id, last_arrival, y AS predicted_headway, {arriving.format('y')} AS predicted_arrival,
        (epoch_us({arriving.format('y')}) - epoch_us({DECEMBER})) / 6e7 AS minutes_remaining FROM e"""
    )
    text = "strftime({}, '%Y-%m-%dT%H:%M:%S.%f')"
    sql["prediction_cells"] = (
        ends
        + f""" SELECT series_id || '#2024-01-31T00:00:00' AS row_key, '7.5' AS predicted_headway,
        {text.format(arriving.format('7.5::DOUBLE'))} AS predicted_arrival_time, {text.format('last_arrival')} AS last_arrival_time FROM e"""
    )
    sql["staleness"] = f"""SELECT user_id, max(ts) AS last_seen, (epoch_us({DECEMBER}) - epoch_us(max(ts))) / 6e7 AS minutes_stale FROM events GROUP BY 1"""
    sql["requests_round_trip"] = (
        BASE + """ SELECT series_id, idx, least(n, 165) AS n, series_id AS unique_id, ds, duration, y FROM clean WHERE idx < 165"""
    )
    sql["request_errors"] = """SELECT event_id AS request_id, 'no rows: send a JSON list of rows, alone or under the name instances' AS error FROM events"""
    sql["short_requests"] = """SELECT user_id, count(*) AS rows,
        count(*) || ' rows are too few: a forecast of 60 needs more rows than that' AS error
        FROM events GROUP BY 1 HAVING count(*) <= 60"""
    sql["responses"] = BASE + " SELECT series_id, idx, y FROM clean WHERE idx >= n - 2"

    sql["stream_updates"] = "SELECT CAST(user_id AS VARCHAR) AS series_id, ts, value AS eta FROM events"
    sql["stream_polled_updates"] = sql["stream_updates"]
    sql["stream_snapshots"] = """WITH s AS (SELECT CAST(user_id AS VARCHAR) AS series_id, date_trunc('minute', ts) AS window_start, count(*) AS updates,
            min(value) AS min_eta, arg_max(value, ts) AS last_eta FROM events GROUP BY 1, 2)
        SELECT series_id, window_start, window_start + INTERVAL 1 MINUTE AS window_end, updates, min_eta, last_eta FROM s
        WHERE epoch_ms(window_start + INTERVAL 1 MINUTE) <= (SELECT epoch_ms(max(ts)) - 120000 FROM events)"""
    for name, behind in (("stream_late_rows", 2), ("stream_late_counts", 1)):
        sql[name] = f"""WITH e AS (SELECT epoch_us(min(ts)) AS low, epoch_us(max(ts)) AS high FROM events),
        p AS (SELECT CAST(user_id AS VARCHAR) AS series_id, ts, value AS eta, CAST(least(3, (epoch_us(ts) - low) * 4 // (high - low + 1)
                + CASE event_id % 40 WHEN 7 THEN 2 WHEN 9 THEN 1 ELSE 0 END) AS INTEGER) AS batch FROM events, e),
        b AS (SELECT batch, count(*) AS rows, max(ts) AS high FROM p GROUP BY 1),
        m AS (SELECT a.batch, any_value(a.rows) AS rows, any_value(a.high) AS high,
                     make_timestamp((epoch_us(max(c.high)) // 1000 - 120000) * 1000) AS watermark
              FROM b a LEFT JOIN b c ON c.batch <= a.batch - {behind} GROUP BY 1)"""
    sql["stream_late_rows"] += " SELECT series_id, ts, eta, p.batch, watermark FROM p JOIN m USING (batch) WHERE ts <= watermark"
    sql["stream_late_counts"] += """ SELECT m.batch, m.rows, count(p.ts) AS late_rows, watermark, high
        FROM m LEFT JOIN p ON p.batch = m.batch AND p.ts <= m.watermark GROUP BY ALL"""
    sql["stream_arrivals"] = DETECTED + f" SELECT series_id, ts, eta, arrival FROM obs WHERE epoch_us(ts) <= {PASSED}"
    sql["stream_headways"] = STREAM_GAPS + " SELECT series_id, ds, y FROM kept"
    sql["stream_features"] = (
        STREAM_GAPS
        + WEATHER
        + f""", f AS (SELECT series_id, ds, y, {_padded(10)} AS p10, {_padded(50)} AS p50, {_padded(60)} AS p60 FROM kept)
        SELECT series_id, f.ds, y, round(list_stddev_samp(p50), 5) AS rolling_std_50, list_max(p10) AS rolling_max_10, round(list_avg(p10), 9) AS rolling_mean_10,
               round(list_stddev_samp(p10), 5) AS rolling_std_10, round(list_avg(p50), 9) AS rolling_mean_50, f.ds + INTERVAL 1 HOUR AS future_ds,
               CAST(isodow(f.ds + INTERVAL 1 HOUR) >= 6 AS INTEGER) AS dow,
               (SELECT arg_max(temp, wx.hour) FROM wx WHERE wx.hour <= {HOUR.replace('epoch_us(ds)', 'epoch_us(f.ds + INTERVAL 1 HOUR)')}) AS temp, p60[1] AS oldest
        FROM f"""
    )
    stamp = "CASE WHEN epoch_us(poll) % 1000000 = 0 THEN strftime(poll, '%Y-%m-%dT%H:%M:%S') ELSE strftime(poll, '%Y-%m-%dT%H:%M:%S.%f') END"
    polled = STREAM_GAPS + ", polled AS (SELECT *, ds + INTERVAL 90 SECOND AS poll FROM kept)"
    sql["stream_predictions"] = (
        polled
        + f""" SELECT 'L#' || series_id || '#' || {stamp} AS doc_id, {stamp} AS timestamp_str, poll AS "timestamp", 'L' AS route_id, series_id AS stop_id,
        y AS predicted_mbt, 'ok' AS status FROM polled"""
    )
    sql["stream_minutes_remaining"] = (
        polled
        + """ SELECT series_id, ds, y AS yhat, (epoch_us(make_timestamp(epoch_us(ds) + CAST(round_even(y * 6e7, 0) AS BIGINT))) - epoch_us(poll)) / 6e7
        AS minutes_remaining FROM polled"""
    )
    sql["stream_trip_durations"] = """SELECT o.event_id // 2 AS trip_id, o.ts AS origin_ts, t.ts AS target_ts, (epoch_us(t.ts) - epoch_us(o.ts)) / 6e7 AS duration
        FROM events o JOIN events t ON t.event_id = o.event_id + 1 AND o.event_id % 2 = 0 WHERE t.ts BETWEEN o.ts AND o.ts + INTERVAL 2 HOUR"""
    return sql
