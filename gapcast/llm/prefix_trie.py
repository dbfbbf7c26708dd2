"""The trie of all beginnings of conversations, by ROLLUP over positional turn columns.

1. Turns get their place in the conversation from the positional layout (``plans/layout.py``),
   which range-partitions by (conversation, turn), so a very long conversation is spread. A turn
   is named by two 64-bit hashes of role and text; turns of the same number stand in their order.
2. A conversation is cut into blocks of ``WIDTH`` places, one row each with the turns as columns
   t1 ... tW. One ``GROUP BY block, prior node, ROLLUP(t1, ..., tW)`` counts all prefixes at
   once; ``grouping_id`` tells a group's depth. Shorter conversations leave null columns, whose
   groups are dropped.
3. Long conversations continue in further blocks, keyed by the prior block's last node. A node
   is named by its depth and two exclusive ors of hashes of (place, turn) over its prefix, 128
   bits, so a block knows its prior node from a running exclusive or over the conversation's
   blocks: all blocks are rolled up by the same statement, whatever the length.
4. Subtree sums: a node's values count at its smallest member. On that conversation's path they
   are summed from the end, so each turn has what its conversation owns at its depth or below,
   and the sum over a node's members is that over its subtree. One sum by node, partial before
   the exchange.
5. Ids of the conversations that end at a node are range-partitioned by (node, id), joined to
   short texts there, and these are read in order by one SHA-256 for each node, as a stream.

Partial aggregation shrinks hot first turns before they move; a hot parent is met in a join
whose exchanges Spark can split. Running sums over a conversation go by stretches of
``STRETCH`` places and over the stretches. Nothing is held but a block's turns and a text of
at most 256 ids.

Rows without conv_id belong to no conversation and take no part; a null role or text counts as
empty; a null turn comes first; repeated rows are turns of their own. An empty table gives no
nodes. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gapcast.plans.layout import attach, positions
from gapcast.plans.scratch import store

WIDTH = 8
STRETCH = 8192
IDS = 256
MOST_SHARED = 6  # h is below it
FAMILY = 100

NODE = ["depth", "x", "y"]


def ordered(conversations: DataFrame) -> DataFrame:
    """conv_id, idx, n, a, b, chars: every turn with its place, its name and the code points of its text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = conversations.select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.col("turn").cast("bigint").alias("turn"),
        F.xxhash64(F.lit(1), role, text).alias("a"),
        F.xxhash64(F.lit(2), role, text).alias("b"),
        F.length(text).cast("bigint").alias("chars"),
    ).where("conv_id IS NOT NULL")
    return positions(turns, ["turn", "a", "b"], ["conv_id"]).select("conv_id", "idx", "n", "a", "b", "chars")


def shared_beginnings(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, pos, a, b, chars) and conversations (conv_id, n) with the borrowed beginnings.

    The first h turns become those of the conversation whose id has the last two digits zero,
    with h by the id's checksum.
    """
    turns = store(turns, "trie-turns")
    own = turns.where("idx = 0").select("conv_id", F.col("n").alias("own"))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % MOST_SHARED
    base = F.col("conv_id") - F.col("conv_id") % FAMILY
    bases = own.where(f"conv_id % {FAMILY} = 0").select(F.col("conv_id").alias("base"), F.col("own").alias("there"))
    facts = own.withColumns({"h": h, "base": base}).join(bases, "base", "left")
    lead = F.least("h", F.coalesce("there", F.lit(0)))
    n = (F.col("lead") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("n")
    facts = store(facts.withColumn("lead", lead).select("conv_id", "base", "h", "lead", n), "trie-conversations")
    heads = turns.where(f"conv_id % {FAMILY} = 0 AND idx < {MOST_SHARED}").withColumnRenamed("conv_id", "base").drop("n")
    borrowed = facts.join(heads, "base").where("idx < lead").select("conv_id", F.col("idx").alias("pos"), "a", "b", "chars")
    kept = attach(turns.drop("n"), facts.select("conv_id", "h", "lead"), ["conv_id"], ["idx"], "inner").where("idx >= h")
    kept = kept.select("conv_id", (F.col("idx") - F.col("h") + F.col("lead")).alias("pos"), "a", "b", "chars")
    return borrowed.unionByName(kept), facts.select("conv_id", "n")


def _names(pos: Column, turn: Column) -> tuple[Column, Column]:
    return F.xxhash64(pos, turn["a"], turn["b"], F.lit(1)), F.xxhash64(pos, turn["a"], turn["b"], F.lit(2))


def _xor(start: Column, terms: list[Column]) -> Column:
    for term in terms:
        start = start.bitwiseXOR(term)
    return start


def _blocks(turns: DataFrame, width: int, stretch: int) -> DataFrame:
    """conv_id, block, px, py (the node before it), t1 ... tW; stored."""
    x, y = _names(F.col("pos"), F.struct("a", "b"))
    keyed = turns.withColumns({"block": F.expr(f"pos div {width}"), "x": x, "y": y})
    listed = F.sort_array(F.collect_list(F.struct("pos", "a", "b", "chars"))).alias("turns")
    rows = keyed.groupBy("conv_id", "block").agg(listed, F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"))
    part = F.expr(f"block div {max(1, stretch // width)}")
    rows = store(rows.withColumn("part", part), "trie-rows")
    none = F.lit(0).cast("bigint")
    before = Window.partitionBy("conv_id", "part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({f"p{c}": F.coalesce(F.bit_xor(c).over(before), none) for c in "xy"})
    # Conversations of one part are all but the very long.
    parts = rows.groupBy("conv_id", "part").agg(F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    long = rows.where("part > 0").select("conv_id").distinct()
    parts = parts.join(long, "conv_id", "left_semi")
    parts = parts.select("conv_id", "part", *[F.bit_xor(c).over(earlier).alias(f"e{c}") for c in "xy"]).where("part > 0")
    joined = rows.drop("x", "y").join(store(parts, "trie-parts"), ["conv_id", "part"], "left")
    at = [F.get("turns", F.lit(i)) for i in range(width)]
    named = [F.when(t.isNotNull(), F.struct(t["a"].alias("a"), t["b"].alias("b"), t["chars"].alias("chars"))) for t in at]
    prior = [_xor(F.col(f"p{c}"), [F.coalesce(f"e{c}", none)]).alias(f"p{c}") for c in "xy"]
    return store(joined.select("conv_id", "block", *prior, *[t.alias(f"t{i + 1}") for i, t in enumerate(named)]), "trie-blocks")


def _path(width: int) -> tuple[Column, Column, Column]:
    """Of a row of ``_blocks`` or of a group of it: the names of the nodes down to t1, ... tW, and the turns."""
    xs, ys, turns = [F.col("px")], [F.col("py")], []
    for i in range(width):
        turn = F.col(f"t{i + 1}")
        a, b = _names(F.col("block") * width + i, turn)
        xs.append(xs[-1].bitwiseXOR(a))
        ys.append(ys[-1].bitwiseXOR(b))
        turns.append(turn)
    return F.array(*xs), F.array(*ys), F.array(*turns)


def _counted(blocks: DataFrame, width: int) -> DataFrame:
    """depth, x, y, up_x, up_y, chars, n_convs, conv_id of each node but the root."""
    columns = ", ".join(f"t{i + 1}" for i in range(width))
    groups = blocks.sparkSession.sql(
        f"""
        SELECT block, px, py, {columns}, {width} - bit_count(grouping_id()) AS level,
               count(*) AS n_convs, min(conv_id) AS conv_id
        FROM {{blocks}}
        GROUP BY block, px, py, ROLLUP({columns})
        """,
        blocks=blocks,
    )
    xs, ys, turns = _path(width)
    own = F.get(turns, F.col("level") - 1)
    nodes = groups.where(F.col("level") > 0).withColumns({"xs": xs, "ys": ys, "own": own}).where("own IS NOT NULL")
    return nodes.select(
        (F.col("block") * width + F.col("level")).alias("depth"),
        F.get("xs", F.col("level")).alias("x"), F.get("ys", F.col("level")).alias("y"),
        F.get("xs", F.col("level") - 1).alias("up_x"), F.get("ys", F.col("level") - 1).alias("up_y"),
        F.col("own.chars").alias("chars"), "n_convs", "conv_id",
    )


def _places(blocks: DataFrame, width: int) -> DataFrame:
    """conv_id, depth, x, y: the node of every turn."""
    xs, ys, turns = _path(width)
    here = lambda i: F.struct(
        (F.col("block") * width + i).alias("depth"), F.get("xs", i).alias("x"), F.get("ys", i).alias("y")
    )
    size = F.size(F.filter(turns, lambda t: t.isNotNull()))
    rows = blocks.withColumns({"xs": xs, "ys": ys, "size": size})
    return rows.select("conv_id", F.inline(F.transform(F.sequence(F.lit(1), F.col("size")), here)))


def _from_end(rows: DataFrame, columns: list[str], stretch: int) -> DataFrame:
    """``columns`` summed over the rows of a conversation at the same depth or deeper."""
    rows = rows.withColumn("part", F.expr(f"(depth - 1) div {stretch}"))
    later = Window.partitionBy("conv_id").orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)
    long = rows.where("part > 0").select("conv_id").distinct()
    parts = rows.join(long, "conv_id", "left_semi").groupBy("conv_id", "part").agg(*[F.sum(c).alias(c) for c in columns])
    parts = store(parts.select("conv_id", "part", *[F.sum(c).over(later).alias(f"_{c}") for c in columns]), "trie-later")
    on = Window.partitionBy("conv_id", "part").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    summed = rows.withColumns({c: F.sum(c).over(on) for c in columns}).join(parts, ["conv_id", "part"], "left")
    return summed.withColumns({c: F.col(c) + F.coalesce(f"_{c}", F.lit(0)) for c in columns}).drop("part", *[f"_{c}" for c in columns])


def _digests(ends: DataFrame) -> DataFrame:
    """depth, x, y, ends_sha256 over (depth, x, y, conv_id), ids ascending and joined by commas."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, first, ids, out = None, None, [], []
        for batch in batches:
            for *key, conv in zip(*(c.to_pylist() for c in batch.columns)):
                if key != node or len(ids) == IDS:
                    if ids:
                        out.append((*node, first, ",".join(ids)))
                    node, first, ids = key, conv, []
                ids.append(str(conv))
            yield pa.RecordBatch.from_pylist([dict(zip(pieces.names, r)) for r in out], schema=pieces)
            out = []
        if ids:
            yield pa.RecordBatch.from_pylist([dict(zip(pieces.names, (*node, first, ",".join(ids))))], schema=pieces)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, sha = None, None
        for batch in batches:
            out = []
            for depth, x, y, text in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 4))):
                if (depth, x, y) == node:
                    sha.update(b",")
                else:
                    if node:
                        out.append({"depth": node[0], "x": node[1], "y": node[2], "ends_sha256": sha.hexdigest()})
                    node, sha = (depth, x, y), hashlib.sha256()
                sha.update(text.encode())
            yield pa.RecordBatch.from_pylist(out, schema=done)
        if node:
            last = {"depth": node[0], "x": node[1], "y": node[2], "ends_sha256": sha.hexdigest()}
            yield pa.RecordBatch.from_pylist([last], schema=done)

    long = [(c, pa.int64()) for c in NODE]
    pieces = pa.schema([*long, ("first", pa.int64()), ("text", pa.string())])
    done = pa.schema([*long, ("ends_sha256", pa.string())])
    keys = ", ".join(f"{c} bigint" for c in NODE)
    dealt = ends.select(*NODE, "conv_id").repartitionByRange(*NODE, "conv_id").sortWithinPartitions(*NODE, "conv_id")
    texts = store(dealt.mapInArrow(join, f"{keys}, first bigint, text string"), "trie-ends")
    return texts.repartition(*NODE).sortWithinPartitions(*NODE, "first").mapInArrow(digest, f"{keys}, ends_sha256 string")


def trie(turns: DataFrame, conversations: DataFrame, width: int = WIDTH, stretch: int = STRETCH) -> DataFrame:
    """One row per node over turns (conv_id, pos, a, b, chars) and conversations (conv_id, n).

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    """
    blocks = _blocks(turns, width, stretch)
    zero = F.lit(0).cast("bigint")
    root = conversations.agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id")).where("n_convs > 0")
    root = root.withColumns({c: zero for c in (*NODE, "chars")}).withColumns({c: F.lit(None).cast("bigint") for c in ("up_x", "up_y")})
    nodes = store(_counted(blocks, width).unionByName(root), "trie-nodes")
    above = [(F.col("depth") - 1).alias("depth"), F.col("up_x").alias("x"), F.col("up_y").alias("y")]
    children = nodes.where("depth > 0").select(*above).groupBy(*NODE).agg(F.count("*").alias("n_children"))
    known = nodes.join(children, NODE, "left").fillna(0, ["n_children"])
    known = known.withColumn("n_leaves", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("bigint"))
    known = store(known.withColumn("saved_tokens", (F.col("n_convs") - 1) * F.col("chars")), "trie-known")
    sums = ["n_leaves", "saved_tokens"]
    places = _places(blocks, width)
    owned = places.join(known.where("depth > 0").select("conv_id", "depth", *sums), ["conv_id", "depth"], "left").fillna(0, sums)
    below = _from_end(store(owned, "trie-owned"), sums, stretch).groupBy(*NODE).agg(*[F.sum(c).alias(c) for c in sums])
    total = known.agg(*[F.sum(c).alias(c) for c in sums]).where("n_leaves > 0").select(*[zero.alias(c) for c in NODE], *sums)
    last = conversations.select("conv_id", F.col("n").alias("depth")).where("depth > 0")
    ends = places.join(last, ["conv_id", "depth"]).select(*NODE, "conv_id")
    turnless = conversations.where("n = 0").select(*[zero.alias(c) for c in NODE], "conv_id")
    digests = store(_digests(ends.unionByName(turnless)), "trie-digests")
    parents = known.select(*[F.col(c).alias(f"of_{c}") for c in NODE], F.col("conv_id").alias("parent_conv_id"))
    out = known.drop(*sums).join(below.unionByName(total), NODE).join(digests, NODE, "left")
    up = (F.col("of_depth") == F.col("depth") - 1) & (F.col("of_x") == F.col("up_x")) & (F.col("of_y") == F.col("up_y"))
    out = out.join(parents, up, "left")
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", empty).alias("ends_sha256"),
    )


def prefix_trie(conversations: DataFrame, width: int = WIDTH, stretch: int = STRETCH, shared: bool = True) -> DataFrame:
    """The trie of conversations (conv_id, turn, role, text), with borrowed beginnings if ``shared``."""
    turns = ordered(conversations)
    if shared:
        return trie(*shared_beginnings(turns), width=width, stretch=stretch)
    turns = store(turns.withColumnRenamed("idx", "pos"), "trie-turns")
    return trie(turns.drop("n"), turns.where("pos = 0").select("conv_id", "n"), width, stretch)


#: The same in DuckDB; the checksum is worked out bit by bit.
ORACLE_SQL = """
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS r, coalesce(text, '') AS x,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS i
  FROM conversations WHERE conv_id IS NOT NULL
), ids AS (
  SELECT c, c - c % 100 AS base,
         xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda s: ascii(s)::BIGINT)),
           lambda acc, byte: list_reduce(list_prepend(xor(acc, byte), range(8)),
             lambda v, k: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384::BIGINT) ELSE v // 2 END)), 4294967295::BIGINT) % 6 AS h
  FROM (SELECT DISTINCT conv_id AS c FROM t)
), rebuilt AS (
  SELECT c, i, r, x FROM ids JOIN t ON t.conv_id = ids.base AND t.i < ids.h
  UNION ALL
  SELECT c, i, r, x FROM ids JOIN t ON t.conv_id = ids.c AND t.i >= ids.h
), prefixes AS (
  SELECT c, x, row_number() OVER w AS d, list({'r': r, 'x': x}) OVER w AS path
  FROM rebuilt WINDOW w AS (PARTITION BY c ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
), lengths AS (
  SELECT ids.c, coalesce(max(d), 0) AS n FROM ids LEFT JOIN prefixes USING (c) GROUP BY ids.c
), nodes AS (
  SELECT d, path, min(p.c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * length(any_value(x)) AS own,
         string_agg(CASE WHEN n = d THEN p.c::VARCHAR END, ',' ORDER BY p.c) AS ends
  FROM prefixes p JOIN lengths USING (c) GROUP BY d, path
  UNION ALL
  SELECT 0, [], min(c), count(*), 0, string_agg(CASE WHEN n = 0 THEN c::VARCHAR END, ',' ORDER BY c)
  FROM lengths HAVING count(*) > 0
), linked AS (
  SELECT n.*, p.conv_id AS parent_conv_id
  FROM nodes n LEFT JOIN nodes p ON p.d = n.d - 1 AND p.path = n.path[1:n.d - 1]
), counted AS (
  SELECT l.*, (SELECT count(*) FROM nodes k WHERE k.d = l.d + 1 AND k.path[1:l.d] = l.path) AS n_children FROM linked l
)
SELECT a.conv_id::BIGINT AS conv_id, a.d::BIGINT AS depth, a.parent_conv_id::BIGINT AS parent_conv_id,
       a.n_convs::BIGINT AS n_convs, a.n_children::BIGINT AS n_children,
       count(*) FILTER (WHERE b.n_children = 0)::BIGINT AS n_leaves, sum(b.own)::BIGINT AS saved_tokens,
       sha256(coalesce(a.ends, '')) AS ends_sha256
FROM counted a JOIN counted b ON b.d >= a.d AND b.path[1:a.d] = a.path
GROUP BY a.conv_id, a.d, a.path, a.parent_conv_id, a.n_convs, a.n_children, a.ends
"""
