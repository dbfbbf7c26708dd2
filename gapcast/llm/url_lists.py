"""URL filters by dated lists: validity intervals and an as-of join, in DataFrame functions only.

A list event says that a pattern of a kind was added to or removed from a category on a day.

1. Events are counted down to one state per pattern, category and day (an addition outranks
   a removal on the same day), so a pattern has at most as many rows as there are days.
   The next day with a state ends an addition's interval.
2. A capture has a key for everything that could list it: its host, every parent domain,
   and every beginning of its path.
3. Intervals are laid out over the months they reach into, up to the last capture. Capture
   keys meet them by kind, pattern and month, and hold where the day lies inside. A hot
   pattern is spread over months and both sides are exchanged for the join alone, so AQE
   can split what stays large.

Captures that repeat (page_id, url and day) are judged once and counted in n_captures. A
null or malformed URL has no host, a null day has no state: neither matches anything.
Events with a null pattern, kind, category or day are ignored. Other columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOST = r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"
PATH = r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)"


def host_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(F.lower(url), HOST, 1), F.lit(""))


def path_parts(url: Column) -> Column:
    return F.filter(F.split(F.coalesce(F.regexp_extract(url, PATH, 1), F.lit("")), "/"), lambda part: part != "")


def keys(host: Column, parts: Column) -> Column:
    """All (kind, pattern) that list a URL."""
    labels = F.split(host, r"\.")
    key = lambda kind, pattern: F.struct(F.lit(kind).alias("kind"), pattern.alias("pattern"))
    domains = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda k: key("domain", F.array_join(F.slice(labels, k, F.size(labels)), ".")),
    )
    depth = F.when(F.size(parts) > 0, F.sequence(F.lit(1), F.size(parts))).otherwise(F.array().cast("array<int>"))
    prefixes = F.transform(depth, lambda k: key("prefix", F.concat(host, F.lit("/"), F.array_join(F.slice(parts, 1, k), "/"))))
    found = F.concat(F.array(key("host", host)), domains, prefixes)
    return F.when(host == "", F.slice(found, 1, 0)).otherwise(found)


def intervals(events: DataFrame) -> DataFrame:
    """(kind, pattern, category, since, until): when a pattern was listed; until is null while it still is."""
    known = events.dropna(subset=["kind", "pattern", "category", "day"])
    states = known.groupBy("kind", "pattern", "category", "day").agg(F.max((F.col("action") == "add").cast("int")).alias("on"))
    order = Window.partitionBy("kind", "pattern", "category").orderBy("day")
    return states.withColumn("until", F.lead("day").over(order)).where("on = 1").select(
        "kind", "pattern", "category", F.col("day").alias("since"), "until"
    )


def evaluate(captures: DataFrame, events: DataFrame) -> DataFrame:
    """page_id, url, day, n_captures, n_active, categories (sorted, comma-separated), blocked for each capture."""
    seen = captures.groupBy("page_id", "url", "day").agg(F.count("*").alias("n_captures"))
    host, parts = host_of(F.col("url")), path_parts(F.col("url"))
    asked = seen.withColumn("k", F.explode_outer(keys(host, parts)))
    asked = asked.select("page_id", "url", "day", "n_captures", "k.kind", "k.pattern", F.trunc("day", "month").alias("month"))
    last = captures.agg(F.max("day")).first()[0]
    listed = intervals(events)
    end = F.least(F.coalesce(F.date_sub("until", 1), F.lit(last)), F.lit(last))
    months = F.sequence(F.trunc("since", "month"), F.trunc(end, "month"), F.expr("INTERVAL 1 MONTH"))
    spread = listed.where(F.col("since") <= end).select(
        F.col("kind").alias("l_kind"), F.col("pattern").alias("l_pattern"), "category", "since", "until", F.explode(months).alias("l_month")
    )
    meets = (F.col("kind") == F.col("l_kind")) & (F.col("pattern") == F.col("l_pattern")) & (F.col("month") == F.col("l_month"))
    active = (F.col("day") >= F.col("since")) & (F.col("until").isNull() | (F.col("day") < F.col("until")))
    joined = asked.join(spread, meets & active, "left")
    judged = joined.groupBy("page_id", "url", "day", "n_captures").agg(
        F.count("category").alias("n_active"), F.array_join(F.array_sort(F.collect_set("category")), ",").alias("categories")
    )
    return judged.withColumn("blocked", F.col("n_active") > 0)


def page_captures(pages: DataFrame) -> DataFrame:
    """Captures of the pages table, which has no times: each page on a day of 2024 that its id gives."""
    return pages.select("page_id", "url", F.expr("date_add(DATE'2024-01-01', CAST(pmod(page_id * 37, 366) AS INT))").alias("day"))


def page_events(pages: DataFrame) -> DataFrame:
    """A dated list made of the same pages: every page lists or unlists its host, domain or path on a day its id gives."""
    host, parts = host_of(F.col("url")), path_parts(F.col("url"))
    labels = F.split(host, r"\.")
    domain = F.array_join(F.slice(labels, F.greatest(F.size(labels) - 2, F.lit(1)), 3), ".")
    turn = F.pmod("page_id", F.lit(3))
    prefix = F.concat(host, F.lit("/"), F.array_join(F.slice(parts, 1, 2), "/"))
    return pages.where(host != "").select(
        F.when(turn == 0, "host").when(turn == 1, "domain").otherwise("prefix").alias("kind"),
        F.when(turn == 0, host).when(turn == 1, domain).otherwise(prefix).alias("pattern"),
        F.concat(F.lit("c"), F.pmod("page_id", F.lit(5)).cast("string")).alias("category"),
        F.when(F.pmod(F.col("page_id") * 31, F.lit(4)) == 0, "remove").otherwise("add").alias("action"),
        F.expr("date_add(DATE'2024-01-01', CAST(pmod(page_id * 53, 366) AS INT))").alias("day"),
    )


ORACLE_SQL = r"""
WITH p AS (SELECT page_id, url, regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1) AS host,
    list_filter(string_split(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '') AS parts FROM pages),
l AS (SELECT *, string_split(host, '.') AS labels FROM p),
captures AS (SELECT page_id, url, host, parts, labels, DATE '2024-01-01' + CAST((page_id * 37) % 366 AS INTEGER) AS day, count(*) AS n_captures
    FROM l GROUP BY ALL),
events AS (SELECT CASE page_id % 3 WHEN 0 THEN 'host' WHEN 1 THEN 'domain' ELSE 'prefix' END AS kind,
    CASE page_id % 3 WHEN 0 THEN host WHEN 1 THEN array_to_string(labels[greatest(len(labels) - 2, 1):greatest(len(labels) - 2, 1) + 2], '.')
        ELSE host || '/' || array_to_string(parts[1:2], '/') END AS pattern,
    'c' || (page_id % 5) AS category, (page_id * 31) % 4 <> 0 AS added, DATE '2024-01-01' + CAST((page_id * 53) % 366 AS INTEGER) AS day
    FROM l WHERE host <> ''),
states AS (SELECT kind, pattern, category, day, bool_or(added) AS added FROM events GROUP BY ALL),
spans AS (SELECT *, lead(day) OVER (PARTITION BY kind, pattern, category ORDER BY day) AS until FROM states),
asked AS (SELECT page_id, url, day, 'host' AS kind, host AS pattern FROM captures
    UNION ALL SELECT page_id, url, day, 'domain', array_to_string(labels[k:], '.') FROM captures, unnest(range(1, len(labels) + 1)) AS t(k)
    UNION ALL SELECT page_id, url, day, 'prefix', host || '/' || array_to_string(parts[1:k], '/') FROM captures, unnest(range(1, len(parts) + 1)) AS t(k)),
hits AS (SELECT page_id, url, a.day, category FROM asked a JOIN spans s ON a.kind = s.kind AND a.pattern = s.pattern AND added
    AND a.day >= s.day AND (until IS NULL OR a.day < until))
SELECT c.page_id, c.url, c.day, n_captures, count(category) AS n_active, coalesce(string_agg(DISTINCT category, ',' ORDER BY category), '') AS categories,
    count(category) > 0 AS blocked
FROM captures c LEFT JOIN hits h ON c.page_id = h.page_id AND c.url IS NOT DISTINCT FROM h.url AND c.day = h.day
GROUP BY c.page_id, c.url, c.day, n_captures
"""
