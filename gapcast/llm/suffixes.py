"""Suffix-array dedup: byte strings of ``length`` that occur twice, from common-prefix interval trees.

1. ``anchors`` keeps a position where a 100-byte hash is the first of the least in a window, so
   every string of ``length`` bytes has one anchor that its content alone fixes. About one
   position in 150 stays, whatever the size of the corpus.
2. An anchor's context is what the strings of ``length`` bytes that have it span: in a run of one
   word, where the same hash comes back at each word, little more than one of them. Contexts
   that occur twice are repeated as a whole; they are counted, never gathered.
3. Contexts that occur once, but whose anchor occurs again, are compared. Their suffixes
   are sorted in an enhanced suffix array, and a stack scan gives its interval tree: each
   interval is a common prefix with all its occurrences. Occurrences in an interval that
   also agree far enough to the left form a maximal repeat, if what stands to the left or
   right of it differs; ``maximal_repeats`` yields each with all its members.
4. Contexts of an anchor with more than ``GROUP`` of them are range-partitioned by what
   stands to the right and again by what stands to the left, twice with other borders, and
   each part is scanned alone. A context's neighbours in the whole order give the longest
   prefix it shares with any other, so it is known where a part's finding is final. Anchors
   with contexts where it may not be have all their windows counted by hash, which needs
   no groups.

Strings of a second, lesser length can be counted as well and are not cut. They are looked for
first, in whole texts; a repeated string of ``length`` bytes lies inside one maximal run of
theirs, so only runs of that size are searched for those that are cut.

Texts are UTF-8 bytes; null counts as empty. Matches do not cross documents. Repeated rows
are repeats of each other, also with the same doc_id. A document's spans are held together,
which its own length bounds. Other columns are left out, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapcast.llm.textbytes import U64, buffer_of, mix, prefix_hash, slices, span_hash
from gapcast.plans.scratch import drop_stored, store, stored_paths

LENGTH = 400
GRAM = 100
GROUP = 800
CELL = 2000
KEY = ["k1", "k2"]
PLACE = [*KEY, "pos", "back", "ahead"]


def _extreme(values: np.ndarray, width: int, best) -> np.ndarray:
    """The least or greatest of each ``width`` values in a row; shorter by width - 1."""
    span, out = 1, values
    while 2 * span <= width:
        out = best(out[:-span], out[span:])
        span *= 2
    rest = width - span
    return best(out[:-rest], out[rest:]) if rest else out


def anchor_windows(data: np.ndarray, offsets: np.ndarray, length: int, gram: int, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions that are the first of the least hashes in some window inside a row, and the span of all such windows.

    Each window of ``length`` bytes, with ``length - gram + 1`` starts of hashed bytes, has one such
    position, and the windows that have the same one follow each other.
    """
    n, window = len(data), length - gram + 1
    if n < length:
        return (np.zeros(0, np.int64),) * 3
    starts = np.arange(n - gram + 1)
    rank = span_hash(sums, starts, starts + gram) & ~U64(0xFFFFFFFF) | starts.astype(np.uint64)
    least = (_extreme(rank, window, np.minimum) & U64(0xFFFFFFFF)).astype(np.int64)  # one for each start of a whole string
    row_end = np.repeat(offsets[1:], np.diff(offsets))[: len(least)]
    whole = np.flatnonzero(np.arange(len(least)) + length <= row_end)
    at = least[whole]
    turn = np.flatnonzero(np.diff(at, prepend=-1, append=-1))
    return at[turn[:-1]], whole[turn[:-1]], whole[turn[1:] - 1] + length


def with_key(documents: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the text, and a 128-bit key of both."""
    text = F.coalesce("text", F.lit(""))
    parts = [F.col("doc_id").cast("string"), text]
    key = F.xxhash64(*parts).alias("k1"), F.xxhash64(F.lit(7), *parts).alias("k2")
    return documents.select("doc_id", *keep, text.alias("text"), *key)


def anchors(documents: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(k1, k2, pos, back, ahead, anchor, context): hashes of the ``gram`` bytes at pos and of the context around."""
    return _anchors(with_key(documents), length, gram)


def _anchors(keyed: DataFrame, length: int, gram: int, within: tuple[str, ...] = ()) -> DataFrame:
    """As ``anchors``; if ``within`` names a column of runs, only strings inside one of a text's runs count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, k1, k2 = batch.column(0), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            first = np.zeros(len(k1), np.int64)
            if within:
                of = [(i, r["start"], r["end"]) for i, runs in enumerate(batch.column(3).to_pylist()) for r in runs]
                raw = [text.encode() for text in texts.to_pylist()]
                texts = pa.array([raw[i][s:e] for i, s, e in of], pa.large_binary())
                row_of, first = np.array([(i, s) for i, s, _ in of], np.int64).reshape(-1, 2).T
                k1, k2 = k1[row_of], k2[row_of]
            data, offsets = buffer_of(texts)
            for i, j in slices(offsets):
                part, rows = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                sums = prefix_hash(part)
                at, low, high = anchor_windows(part, rows, length, gram, sums)
                row = np.searchsorted(rows, at, "right") - 1
                around = span_hash(sums, low, high) + mix(((at - low) * 1024 + high - at).astype(np.uint64), 2)
                arrays = [k1[i:j][row], k2[i:j][row], *(x.astype(np.int32) for x in (at - rows[row] + first[i:j][row], at - low, high - at))]
                arrays += [span_hash(sums, at, at + gram).view(np.int64), mix(around, 1).view(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], names=[*PLACE, "anchor", "context"])

    rows = keyed.where(F.octet_length("text") >= length).select("text", *KEY, *within)
    return rows.mapInArrow(run, "k1 bigint, k2 bigint, pos int, back int, ahead int, anchor bigint, context bigint")


def _common(a: bytes, b: bytes) -> int:
    """The length of the common beginning."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low = 0
    while n - low > 1:
        mid = (low + n) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            n = mid
    return low


def intervals(texts: list[bytes]) -> Iterator[tuple[int, int, int]]:
    """The common-prefix interval tree of sorted texts: (first, last, depth), inner ones before outer."""
    stack: list[tuple[int, int]] = []
    for i, depth in enumerate([_common(a, b) for a, b in zip(texts, texts[1:])] + [-1]):
        start = i
        while stack and stack[-1][0] > depth:
            inner, start = stack.pop()
            yield start, i, inner
        if depth >= 0 and (not stack or stack[-1][0] < depth):
            stack.append((depth, start))


def maximal_repeats(rights: list[bytes], lefts: list[bytes], length: int) -> Iterator[tuple[list[int], int, int]]:
    """Groups (members, l, r): l bytes before and r bytes from the anchor that all members share, l + r >= length.

    ``rights`` are sorted suffixes, ``lefts`` what stands before them, read backwards. Groups
    are told from shorter ones by diversity: members differ right after and right before.
    """
    for first, last, r in intervals(rights):
        order = sorted((lefts[i], i) for i in range(first, last + 1) if len(lefts[i]) >= length - r)
        for low, high, l in intervals([text for text, _ in order]):
            members = [i for _, i in order[low : high + 1]]
            # Rights are sorted: what the outer two share, all share.
            if l + r >= length and _common(rights[min(members)], rights[max(members)]) == r:
                yield members, l, r


def _near(texts: list[bytes]) -> tuple[list[int], list[int]]:
    """The order of the texts, and for each the longest beginning it shares with any other."""
    order = sorted(range(len(texts)), key=texts.__getitem__)
    shared = [0, *(_common(texts[a], texts[b]) for a, b in zip(order, order[1:])), 0]
    near = [0] * len(texts)
    for k, i in enumerate(order):
        near[i] = max(shared[k], shared[k + 1])
    return order, near


def _furthest(texts: list[bytes], order: list[int], others: list[bytes], near: list[int], length: int) -> list[int]:
    """For each text the depth of the innermost interval with a member whose other side agrees too; 0 if none.

    The other sides of an interval of depth d must share ``length`` - d bytes; ``near`` is
    the most that one shares with any other. What has been found inside is only a partner further out.
    """
    best = [0] * len(texts)
    for first, last, depth in intervals([texts[i] for i in order]):
        need = max(0, length - depth)
        members = [i for i in order[first : last + 1] if near[i] >= need]
        if len(members) < 2 or all(best[i] for i in members):
            continue
        sides: dict[bytes, list[int]] = {}
        for i in members:
            sides.setdefault(others[i][:need], []).append(i)
        for group in sides.values():
            if len(group) > 1:
                for i in group:
                    best[i] = best[i] or depth
    return best


def reaches(lefts: list[bytes], rights: list[bytes], length: int) -> tuple[list[int], list[int]]:
    """How far the repeats of ``length`` or more over one anchor reach to the left and right of each context."""
    by_left, near_left = _near(lefts)
    by_right, near_right = _near(rights)
    after = _furthest(rights, by_right, lefts, near_left, length)
    before = _furthest(lefts, by_left, rights, near_right, length)
    return before, after


def _by_key(keys: np.ndarray) -> Iterator[np.ndarray]:
    """The places of each key."""
    order = np.argsort(keys, kind="stable")
    cuts = np.flatnonzero(np.diff(keys[order])) + 1
    yield from np.split(order, cuts) if len(order) else ()


def _grow(length: int):
    """One cell: for each context how far its longest repeats reach to the left and right."""

    def run(cell):
        before, after = np.zeros(len(cell), np.int32), np.zeros(len(cell), np.int32)
        lefts, rights = cell["left"].to_numpy(), cell["right"].to_numpy()
        for at in _by_key(cell["key"].to_numpy()):
            before[at], after[at] = reaches([lefts[i] for i in at], [rights[i] for i in at], length)
        return cell.assign(before=before, after=after)

    return run


def _scan(side: str, length: int):
    """One part of the order by ``side``: as ``_grow``, and the longest prefix shared with a neighbour."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [b for b in batches if len(b)]
        if not parts:
            return
        cell = pd.concat(parts)
        keys, texts = cell["key"].tolist(), cell[side].tolist()
        order = sorted(range(len(cell)), key=lambda i: (keys[i], texts[i]))
        shared = [_common(texts[a], texts[b]) if keys[a] == keys[b] else 0 for a, b in zip(order, order[1:])]
        near, place = np.zeros(len(cell), np.int64), np.zeros(len(cell), np.int64)
        near[order], place[order] = np.maximum([0, *shared], [*shared, 0]), np.arange(len(cell))
        marks = grow(cell).assign(near=near, head=place == 0, tail=place == len(cell) - 1, side=side)
        yield marks.assign(part=TaskContext.get().partitionId()).drop(columns=["left", "right", "key"])

    grow = _grow(length)
    return run


_CONTEXT = "k1 bigint, k2 bigint, pos int, anchor bigint, `left` binary, `right` binary, key bigint, before int, after int"


def _contexts(fetch: DataFrame, keyed: DataFrame) -> DataFrame:
    """The bytes around the wanted positions; those to the left read backwards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, k1, k2, spots in zip(*(batch.column(i).to_pylist() for i in range(4))):
                text = text.encode()
                for s in spots:
                    p = s["pos"]
                    rows.append((k1, k2, p, s["anchor"], text[p - s["back"] : p][::-1], text[p : p + s["ahead"]], s["anchor"], 0, 0))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)] if rows else [pa.array([], t) for t in kinds], names=names)

    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int32(), pa.int32()]
    names = [*KEY, "pos", "anchor", "left", "right", "key", "before", "after"]
    spots = fetch.groupBy(*KEY).agg(F.collect_list(F.struct("pos", "back", "ahead", "anchor")).alias("spots"))
    joined = keyed.select("text", *KEY).join(spots, KEY)
    return joined.select("text", *KEY, "spots").mapInArrow(run, _CONTEXT)


def _split_groups(hot: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """How far repeats of contexts in large groups reach, and contexts of anchors where that may be too little."""
    parts, scans = max(1, -(-hot.count() // CELL)), []
    kinds = "k1 bigint, k2 bigint, pos int, anchor bigint, before int, after int, near bigint, head boolean, tail boolean, side string, part int"
    for side in ("right", "left"):
        for turn in range(2):
            ranged = hot.repartitionByRange(parts + turn, "key", side, *KEY, "pos")
            scan = store(ranged.mapInPandas(_scan(side, length), kinds), "scan")
            last = scan.agg(F.max("part")).first()[0] or 0
            # What stands beyond a part's border is not known.
            beyond = (F.col("head") & (F.col("part") > 0)) | (F.col("tail") & (F.col("part") < last))
            scans.append(scan.withColumn("near", F.when(beyond, 2 * length).otherwise(F.col("near"))))
    rows = scans[0]
    for scan in scans[1:]:
        rows = rows.unionByName(scan)
    near = [F.min(F.when(F.col("side") == s, F.col("near"))).alias(f"near_{s}") for s in ("left", "right")]
    reached = F.max("before").alias("before"), F.max("after").alias("after")
    known = store(rows.groupBy(*KEY, "pos", "anchor").agg(*reached, *near), "reached")
    possible = (F.col("near_left") + F.col("near_right") >= length) & (
        (F.col("near_right") > F.col("after")) | (F.col("near_left") > F.col("before"))
    )
    # The windows that could reach further, by their start before the anchor, for each anchor:
    # to the right those up to ``length - after - 1``, to the left those from ``before + 1``.
    least = F.greatest(length - F.col("near_right"), F.lit(0))
    to_right = F.col("near_right") > F.col("after")
    to_left = F.col("near_left") > F.col("before")
    unsure = known.where(possible).groupBy("anchor").agg(
        F.min(F.when(to_right, least)).alias("right_low"),
        F.max(F.when(to_right, F.least(length - F.col("after") - 1, F.col("near_left")))).alias("right_high"),
        F.min(F.when(to_left, F.greatest(F.col("before") + 1, least))).alias("left_low"),
        F.max(F.when(to_left, F.col("near_left"))).alias("left_high"),
    )
    unsure = store(unsure.withColumnRenamed("anchor", "a"), "open-anchors")
    # All contexts of such an anchor take part: a partner may be settled itself.
    facts = known.drop("anchor").withColumnsRenamed({"before": "found_before", "after": "found_after"})
    open_ = hot.join(unsure, F.col("anchor") == F.col("a")).join(facts, [*KEY, "pos"])
    return known.select(*KEY, "pos", "before", "after"), open_


def _windows(rows: DataFrame, length: int) -> DataFrame:
    """Spans of windows over the anchors of ``rows`` that occur twice, by counting their hashes.

    A window that reaches further to a side than any neighbour shares can't occur twice. Contexts
    share no window, so each comes once.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k in range(0, len(batch), 2000):
                part = batch.iloc[k : k + 2000]
                before = part["left"].map(len).to_numpy()
                after = part["right"].map(len).to_numpy()
                buffer = np.frombuffer(b"".join(a[::-1] + b for a, b in zip(part["left"], part["right"])), np.uint8)
                base = np.cumsum(before + after) - after  # where the anchors stand
                low = np.maximum(0, length - np.minimum(after, part["near_right"].to_numpy()))
                high = np.minimum(before, part["near_left"].to_numpy())
                many = np.maximum(high - low + 1, 0)
                at = np.repeat(np.arange(len(part)), many)
                back = low[at] + np.arange(len(at)) - (np.cumsum(many) - many)[at]
                limits = {c: part[c].fillna(-1).to_numpy(np.int64)[at] for c in ("right_low", "right_high", "left_low", "left_high")}
                wanted = (back >= limits["right_low"]) & (back <= limits["right_high"])
                wanted |= (back >= limits["left_low"]) & (back <= limits["left_high"]) & (limits["left_low"] >= 0)
                at, back = at[wanted], back[wanted]
                start = base[at] - back
                anchor = part["anchor"].to_numpy()[at]
                hashes = mix(span_hash(prefix_hash(buffer), start, start + length), 9) + anchor.view(np.uint64)
                columns = {"hash": hashes.view(np.int64), "anchor": anchor}
                columns |= {c: part[c].to_numpy()[at] for c in KEY}
                columns["new"] = (back > part["found_before"].to_numpy()[at]) | (length - back > part["found_after"].to_numpy()[at])
                yield pd.DataFrame({**columns, "start": (part["pos"].to_numpy()[at] - back).astype(np.int32)})

    found = store(rows.mapInPandas(run, "hash bigint, anchor bigint, k1 bigint, k2 bigint, new boolean, start int"), "windows")
    twice = found.groupBy("hash", "anchor").agg(F.count("*").alias("n")).where("n > 1")
    twice = twice.select(F.bitwise_not("hash").alias("same"), F.col("anchor").alias("of"))
    hit = found.where("new").join(twice, (F.bitwise_not("hash") == F.col("same")) & (F.col("anchor") == F.col("of")))
    return hit.select(*KEY, "start", (F.col("start") + length).alias("end"))


def repeated_spans(documents: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(k1, k2, start, end): spans, maybe overlapping, whose union is every byte in a repeated string."""
    return _spans(with_key(documents), length, gram)


def _spans(keyed: DataFrame, length: int, gram: int, within: tuple[str, ...] = ()) -> DataFrame:
    """As ``repeated_spans``, for rows with ``text``, their key and what ``within`` names."""
    rows = store(_anchors(keyed, length, gram, within), "anchors")
    pick = [F.first(c).alias(c) for c in PLACE]
    contexts = rows.groupBy("anchor", "context").agg(F.count("*").alias("n"), *pick)
    contexts = store(contexts, "contexts")
    again = contexts.where("n > 1").select(F.col("anchor").alias("a"), F.col("context").alias("c"))
    whole = rows.join(again, (F.col("anchor") == F.col("a")) & (F.col("context") == F.col("c")))
    spans = whole.select(*KEY, (F.col("pos") - F.col("back")).alias("start"), (F.col("pos") + F.col("ahead")).alias("end"))
    several = contexts.groupBy("anchor").agg(F.count("*").alias("m"), F.min("n").alias("least")).where("m > 1 AND least = 1")
    several = store(several.select(F.col("anchor").alias("a")), "several")
    fetch = store(contexts.join(several, F.col("anchor") == F.col("a")).select("anchor", *PLACE), "fetch")
    open_ = store(_contexts(fetch, keyed), "context-bytes")
    sizes = open_.groupBy("key").agg(F.count("*").alias("size")).where(F.col("size") > GROUP)
    sizes = store(sizes.select(F.col("key").alias("big")), "big-groups")
    cells = max(1, -(-open_.count() // CELL))
    small = open_.join(sizes, F.col("key") == F.col("big"), "left_anti").withColumn("cell", F.pmod(F.xxhash64("key"), F.lit(cells)))
    reached = small.groupBy("cell").applyInPandas(_grow(length), _CONTEXT + ", cell bigint").select(*KEY, "pos", "before", "after")
    hot = open_.join(sizes, F.col("key") == F.col("big"), "left_semi")
    if not sizes.isEmpty():
        known, unsure = _split_groups(store(hot, "large-groups"), length)
        reached = reached.unionByName(known)
        spans = spans.unionByName(_windows(unsure, length))
    grown = reached.where("after > 0")
    ends = (F.col("pos") - F.col("before")).alias("start"), (F.col("pos") + F.col("after")).alias("end")
    return spans.unionByName(grown.select(*KEY, *ends))


def merged(starts: list[int], ends: list[int], size: int) -> list[tuple[int, int]]:
    """Maximal runs of the spans' union, inside ``size`` bytes."""
    runs: list[tuple[int, int]] = []
    for s, e in sorted(zip(starts, ends)):
        s, e = max(s, 0), min(e, size)
        if runs and s <= runs[-1][1]:
            runs[-1] = (runs[-1][0], max(runs[-1][1], e))
        else:
            runs.append((s, e))
    return runs


def _collected(spans: DataFrame) -> DataFrame:
    """(k1, k2, spans): all spans of a text."""
    return spans.distinct().groupBy(*KEY).agg(F.collect_list(F.struct("start", "end")).alias("spans"))


def with_runs(keyed: DataFrame, length: int, gram: int) -> DataFrame:
    """``keyed`` and ``runs``, the maximal runs of bytes in repeated strings of ``length``; stored.

    The intermediate tables of the search are deleted.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [([s["start"] for s in spans], [s["end"] for s in spans]) for spans in batch.column(2).to_pylist()]
            made = pa.array([[{"start": s, "end": e} for s, e in merged(starts, ends, max(ends))] for starts, ends in found], kind)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), made], names=[*KEY, "runs"])

    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    before = set(stored_paths())
    collected = _collected(_spans(keyed, length, gram))
    runs = store(collected.mapInArrow(run, "k1 bigint, k2 bigint, runs array<struct<start int, end int>>"), "runs")
    mine = [p for p in stored_paths() if p not in before]
    drop_stored(keyed.sparkSession, mine[:-1])
    return store(keyed.join(runs, KEY, "left"), "texts-with-runs")


def dedup(documents: DataFrame, length: int = LENGTH, gram: int = GRAM, keep: tuple[str, ...] = (), marked: tuple[int, int] | None = None) -> DataFrame:
    """doc_id, the columns named in ``keep``, n_bytes, n_removed, n_spans, kept_sha256 and kept_text.

    kept_text leaves out what a span has left of a character it cut; the hash is of all kept bytes.
    With ``marked``, a length up to ``length`` and its gram, also n_repeated and n_repeated_spans:
    the bytes in strings of that length that start elsewhere too, cut or not, and their maximal runs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            get = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            rows = []
            for text, spans in zip(get["text"], get["spans"].to_pylist()):
                text = text.as_py().encode()
                runs = merged([s["start"] for s in spans or ()], [s["end"] for s in spans or ()], len(text))
                ends = [0, *(e for _, e in runs)]
                rest = b"".join(text[e:s] for e, s in zip(ends, [*(s for s, _ in runs), len(text)]))
                rows.append((len(text), len(text) - len(rest), len(runs), hashlib.sha256(rest).hexdigest(), rest.decode("utf-8", "ignore")))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            made = [pa.array(c, t) for c, t in zip(zip(*rows), kinds)] if rows else [pa.array([], t) for t in kinds]
            kept = [get[c] for c in [*others, *counted]]
            yield pa.RecordBatch.from_arrays([*kept, *made], names=[*others, *counted, *cut])

    others, counted = ["doc_id", *keep], ["n_repeated", "n_repeated_spans"] if marked else []
    cut = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"]
    wide = with_key(documents, keep)
    kinds = {f.name: f.dataType.simpleString() for f in wide.schema}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in others) + "".join(f", {c} bigint" for c in counted)
    schema += ", n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept_text string"
    if marked is None:
        found = _collected(repeated_spans(documents, length, gram))
        return wide.join(found, KEY, "left").select(*others, "text", "spans").mapInArrow(run, schema)
    if marked[0] > length:
        raise ValueError("strings that are counted may not be longer than those that are cut")
    texts = with_runs(wide, *marked)
    size = F.aggregate("runs", F.lit(0).cast("bigint"), lambda n, r: n + r["end"] - r["start"])
    numbers = F.coalesce(size, F.lit(0)).alias("n_repeated"), F.greatest(F.size("runs"), F.lit(0)).cast("bigint").alias("n_repeated_spans")
    long = F.coalesce(F.exists("runs", lambda r: r["end"] - r["start"] >= length), F.lit(False))
    rest = texts.where(~long).withColumn("spans", F.lit(None).cast("array<struct<start:int,end:int>>"))
    within = texts.where(long).withColumn("runs", F.filter("runs", lambda r: r["end"] - r["start"] >= length))
    found = _collected(_spans(within, length, gram, ("runs",)))
    every = texts.where(long).join(found, KEY, "left").unionByName(rest)
    rows = every.select(*others, *numbers, "text", "spans").mapInArrow(run, schema)
    return rows.select(*others, *cut, *counted)
