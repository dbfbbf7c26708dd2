"""MinHash near-dedup by fast similarity sketching, banding and exact verification.

1. ``sketches`` hashes the words of whole texts in numpy and fills ``COORDINATES`` bins in
   rounds: in each of the first t rounds every shingle is thrown into one hashed bin with a
   hashed value, and round t + i puts all shingles into bin i. An earlier round always wins,
   so a document stops at the round that fills its last bin, and two sets agree in a
   coordinate with the probability of their similarity, with the concentration of
   independent hashes. Short sets fill all bins too.
2. Documents with equal shingle sets form a class, whose id is a hash of the set's signature;
   one row of it goes on.
3. Two classes meet where all rows of a band agree. A pair at the least similarity misses
   all ``BANDS`` bands with a probability under 4e-6.
4. Each bucket is first compared with its smallest member. Buckets with the same smallest
   member form a group. A group that is left in several components is compared in full, in
   blocks of ``BLOCK`` x ``BLOCK``: pairs of different components that share a band, and
   whose sketches do not agree in fewer coordinates than five standard deviations below the
   least similarity. No pair is left out for its group's size.
5. Every link is confirmed on the full sets. A block yields links that join what is not
   yet joined in it, at most one per document, and never its pairs.

A null or empty text, or one of white space, has no shingle, is linked with nothing and is
its own component. A row without doc_id is linked with nothing, has no component and is kept;
``judged`` can take it like the others. Rows with the same doc_id are told apart by their sets,
so two texts under one doc_id are two documents; each row gives a row, and one row of a
component is kept. A component is shown by its smallest doc_id. Other columns are left out,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapcast.llm.links import components
from gapcast.llm.textbytes import U64, buffer_of, mix, shingles, slices
from gapcast.plans.scratch import store

WIDTH = 4
PERCENT = 80
ROWS, BANDS = 5, 32
COORDINATES = ROWS * BANDS
BLOCK = 256
SIGNATURE = ["n_shingles", "s1", "s2"]
_FULL = U64(0xFFFFFFFFFFFFFFFF)


def fill(sets: list[np.ndarray], t: int = COORDINATES) -> np.ndarray:
    """The sketches of non-empty sets, one row each: the round and value that won each bin."""
    out = np.full((len(sets), t), _FULL)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    items = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    flat = out.reshape(-1)
    for turn in range(2 * t):
        if not len(items):
            break
        x = mix(items, 1000 + turn)
        value = (U64(turn) << U64(48)) | (x >> U64(16))
        bins = ((x & U64(0xFFFF)) * U64(t) >> U64(16)).astype(np.int64) if turn < t else turn - t
        np.minimum.at(flat, owner * t + bins, value)
        open_ = (out == _FULL).any(1)
        if not open_.all():
            stay = open_[owner]
            owner, items = owner[stay], items[stay]
    return out


def _sets(column: pa.Array, width: int) -> Iterator[list[np.ndarray]]:
    data, offsets = buffer_of(column)
    for i, j in slices(offsets):
        yield list(shingles(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], width))


def _signs(sets: list[np.ndarray]) -> list[pa.Array]:
    """The sizes of the sets and their 128-bit signatures."""
    signs = [np.array([mix(s, k).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64) for k in (11, 12)]
    return [pa.array(np.array([len(s) for s in sets], np.int64)), *map(pa.array, signs)]


def _content() -> Column:
    """By what a row's text is found again."""
    return F.xxhash64("doc_id", "text")


def sketches(documents: DataFrame, width: int = WIDTH) -> DataFrame:
    """row, content, doc_id, n_shingles, the set's 128-bit signature (s1, s2), and 16 bits of each coordinate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for sets in _sets(batch.column(3), width):
                full = [k for k, s in enumerate(sets) if len(s)]
                coordinates: list[bytes | None] = [None] * len(sets)
                low = mix(fill([sets[k] for k in full]), 5).astype("<u2")
                for k, row in zip(full, low):
                    coordinates[k] = row.tobytes()
                own = [batch.column(i).slice(at, len(sets)) for i in range(3)]
                arrays = [*own, *_signs(sets), pa.array(coordinates, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names=["row", "content", "doc_id", "n_shingles", "s1", "s2", "sketch"])
                at += len(sets)

    return documents.select("row", _content().alias("content"), "doc_id", "text").mapInArrow(
        run, "row bigint, content bigint, doc_id bigint, n_shingles bigint, s1 bigint, s2 bigint, sketch binary"
    )


def full_sets(documents: DataFrame, width: int = WIDTH) -> DataFrame:
    """(id, items): the class of each text and its sorted shingle hashes as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for sets in _sets(batch.column(0), width):
                items = pa.array([s.tobytes() for s in sets], pa.binary())
                yield pa.RecordBatch.from_arrays([*_signs(sets), items], names=[*SIGNATURE, "items"])

    found = documents.select("text").mapInArrow(run, "n_shingles bigint, s1 bigint, s2 bigint, items binary")
    return found.select(F.xxhash64(*SIGNATURE).alias("id"), "items")


class Joined:
    """Which members of a block are joined already."""

    def __init__(self) -> None:
        self.up: dict = {}

    def root(self, x):
        while (y := self.up.get(x, x)) != x:
            self.up[x] = self.up.get(y, y)
            x = y
        return x

    def join(self, a, b) -> bool:
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def _similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets are similar enough."""
    if len(x) > len(y):
        x, y = y, x
    if 100 * len(x) < percent * len(y):
        return False
    at = np.searchsorted(y, x)
    shared = int((y[np.minimum(at, len(y) - 1)] == x).sum())
    return 100 * shared >= percent * (len(x) + len(y) - shared)


def _confirm(percent: int):
    """Confirms the pairs of a block on full sets; gives links that join what is apart."""

    def run(pairs, members):
        items = {d: np.frombuffer(b, np.uint64) for d, b in zip(members["id"], members["items"])}
        joined, found = Joined(), []
        for a, b in zip(pairs["a"], pairs["b"]):
            if joined.root(a) != joined.root(b) and _similar(items[a], items[b], percent):
                joined.join(a, b)
                found.append((a, b))
        return pd.DataFrame(found, columns=["a", "b"]).astype("int64")

    return run


def _sets_of(wanted: DataFrame, classes: DataFrame, documents: DataFrame, width: int) -> DataFrame:
    """Full sets of the classes in ``wanted`` (id)."""
    places = classes.join(wanted.distinct(), "id", "left_semi").select("content")
    texts = documents.withColumn("content", _content()).join(places, "content", "left_semi")
    return store(full_sets(texts, width).dropDuplicates(["id"]), "sets")


def _first_links(pairs: DataFrame, classes: DataFrame, documents: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (a, b) among ``pairs`` (block, a, b); a set is sent once to each block."""
    needed = store(pairs.select("block", F.explode(F.array("a", "b")).alias("id")).distinct(), "pair-members")
    members = needed.join(_sets_of(needed.select("id"), classes, documents, width), "id")
    linked = pairs.groupBy("block").cogroup(members.groupBy("block")).applyInPandas(_confirm(percent), "a bigint, b bigint")
    return store(linked, "first-links")


def _first_pairs(rows: DataFrame) -> DataFrame:
    """Every member of a bucket with the bucket's smallest; a class's partners go to blocks of bounded size."""
    pairs = rows.where("id > least").select(F.col("least").alias("a"), F.col("id").alias("b"))
    degree = pairs.groupBy("a").agg(F.count("*").alias("n"))
    busy = store(degree.where(F.col("n") > BLOCK), "star-hubs").select(F.col("a").alias("hub"), "n")
    count = pairs.count()
    spread = max(1, -(-count // BLOCK))
    split = pairs.join(busy, F.col("a") == F.col("hub"), "left")
    salt = F.pmod(F.xxhash64("b"), F.coalesce(F.ceil(F.col("n") / BLOCK), F.lit(1)))
    apart = F.xxhash64("a", salt)
    block = F.when(F.col("hub").isNotNull(), apart).otherwise(F.pmod(F.xxhash64("a"), F.lit(spread)))
    return store(split.select(block.alias("block"), "a", "b"), "pairs")


def _compare(percent: int):
    """Links between the parts in a block of two chunks of a group: a band shared, sketches near enough, sets similar."""
    share = percent / 100
    least = share - 5 * np.sqrt(share * (1 - share) / COORDINATES)

    def run(group):
        left, right = group[group["side"] != 1], group[group["side"] != 0]
        own = group["side"].iloc[0] == 2  # a chunk with itself
        x, y = (np.stack([np.frombuffer(b, "<u2") for b in g["sketch"]]) if len(g) else np.zeros((0, COORDINATES), "<u2") for g in (left, right))
        ids, parts, sizes, items = (
            [g[c].to_numpy() for g in (left, right)] for c in ("id", "part", "n", "items")
        )
        sets = [[np.frombuffer(b, np.uint64) for b in side] for side in items]
        joined, found = Joined(), []
        for i in range(0, len(x), 32):
            same = x[i : i + 32, None, :] == y[None, :, :]
            good = (same.mean(2) >= least) & same.reshape(*same.shape[:2], BANDS, ROWS).all(3).any(2)
            small = sizes[0][i : i + 32, None], sizes[1][None, :]
            good &= (parts[0][i : i + 32, None] != parts[1][None, :]) & (
                100 * np.minimum(*small) >= percent * np.maximum(*small)
            )
            if own:
                good &= ids[0][i : i + 32, None] < ids[1][None, :]
            for a, b in np.argwhere(good):
                p, q = parts[0][i + a], parts[1][b]
                if joined.root(p) != joined.root(q) and _similar(sets[0][i + a], sets[1][b], percent):
                    joined.join(p, q)
                    found.append((ids[0][i + a], ids[1][b]))
        return pd.DataFrame(found, columns=["a", "b"]).astype("int64")

    return run


def _other_links(rows: DataFrame, classes: DataFrame, parts: DataFrame, documents: DataFrame, width: int, percent: int) -> DataFrame:
    """Links between different components of a group, which is all that shares a bucket with its smallest member."""
    groups = rows.select(F.col("least").alias("key"), "id")
    placed = groups.join(parts, groups.id == parts.node, "left").withColumn("part", F.coalesce("component", "id"))
    placed = store(placed.select("key", "id", "part"), "group-parts")
    mixed = placed.groupBy("key").agg(F.min("part").alias("p"), F.max("part").alias("q"), F.count("*").alias("size"))
    mixed = store(mixed.where("p < q").select("key", "size"), "mixed-groups").withColumnRenamed("key", "mixed")
    dealt = placed.join(mixed, F.col("key") == F.col("mixed")).withColumn("chunks", F.ceil(F.col("size") / BLOCK).cast("int"))
    dealt = store(dealt.withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int")), "group-chunks")
    sides = F.transform(
        F.sequence(F.lit(0), F.col("chunks") - 1),
        lambda k: F.struct(
            F.least("chunk", k).alias("i"),
            F.greatest("chunk", k).alias("j"),
            F.when(k == F.col("chunk"), 2).when(F.col("chunk") < k, 0).otherwise(1).alias("side"),
        ),
    )
    spread = dealt.select("key", "id", "part", F.explode(sides).alias("s"))
    spread = spread.select(F.xxhash64("key", "s.i", "s.j").alias("block"), "id", "part", "s.side")
    sets = _sets_of(dealt.select("id"), classes, documents, width)
    facts = classes.select("id", F.col("n_shingles").alias("n"), "sketch").join(sets, "id")
    full = spread.join(store(facts, "group-members"), "id")
    return store(full.groupBy("block").applyInPandas(_compare(percent), "a bigint, b bigint"), "other-links")


def judged(documents: DataFrame, width: int = WIDTH, percent: int = PERCENT, unnamed: bool = True) -> DataFrame:
    """row, doc_id, n_shingles, component_id, kept for every row of ``documents`` (row, doc_id, text).

    Rows are told apart by ``row`` alone. With ``unnamed``, rows without doc_id are linked like the others.
    """
    drawn = store(sketches(documents, width), "sketches")
    taken = F.col("n_shingles") > 0 if unnamed else (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    order = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "content", "row", "sketch")
    least = drawn.where(taken).groupBy(*SIGNATURE).agg(F.min(order).alias("c"))
    classes = store(least.select(*SIGNATURE, F.xxhash64(*SIGNATURE).alias("id"), "c.doc_id", "c.content", "c.row", "c.sketch"), "classes")
    bands = classes.select("id", "sketch", F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1))).alias("band"))
    start = (F.col("band") * 2 * ROWS + 1).cast("int")
    part = F.substring(F.col("sketch"), start, F.lit(2 * ROWS))
    bands = bands.select(F.xxhash64("band", part).alias("key"), "id")
    shared = bands.groupBy("key").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most")
    shared = shared.select(F.bitwise_not("key").alias("shared"), "least")
    rows = bands.withColumn("shared", F.bitwise_not("key")).join(shared, "shared").select("id", "least").distinct()
    rows = store(rows, "buckets")
    links = _first_links(_first_pairs(rows), classes, documents, width, percent)
    parts = store(components(links), "parts")
    more = _other_links(rows, classes, parts, documents, width, percent)
    if not more.isEmpty():
        parts = store(components(links.unionByName(more)), "parts")
    grouped = classes.select(*SIGNATURE, "id", "doc_id", "row").join(parts, F.col("id") == F.col("node"), "left")
    grouped = store(grouped.withColumn("component", F.coalesce("component", "id")), "class-parts")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "id", "row")).alias("c")
    tops = grouped.where("node IS NOT NULL").groupBy("component").agg(first)
    tops = store(tops.select(F.bitwise_not("component").alias("key"), F.col("c.doc_id").alias("shown"), F.col("c.row").alias("top")), "tops")
    known = grouped.withColumn("key", F.bitwise_not("component")).join(tops, "key", "left")
    known = known.select(*SIGNATURE, F.coalesce("shown", "doc_id").alias("shown"), F.coalesce("top", "row").alias("top"))
    out = drawn.join(store(known, "class-tops"), SIGNATURE, "left")
    named = F.lit(True) if unnamed else F.col("doc_id").isNotNull()
    component = F.when(named, F.coalesce("shown", "doc_id"))
    kept = ~named | F.coalesce(F.col("top") == F.col("row"), F.lit(True))
    return out.select("row", "doc_id", "n_shingles", component.alias("component_id"), kept.alias("kept"))


def near_duplicates(documents: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row."""
    rows = documents.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return judged(rows, width, percent, unnamed=False).drop("row")
