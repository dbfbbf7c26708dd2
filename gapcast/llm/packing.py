"""Best-fit packing of tokenised documents by large-item matching.

1. One pass tokenises whole texts and cuts them into pieces; a piece knows its rank among
   the pieces of its length in its task.
2. Only the number of pieces of each length (at most ``capacity`` numbers) reaches the
   driver. There, pieces above a third of the capacity, of which no bin holds more than
   two, are matched largest with largest that fits; smaller ones fill the tightest gap
   that takes them, largest first. Equal bins are handled together, so the plan has a few
   thousand lines however many pieces there are.
3. A piece finds its sequence and offset from its length and its rank.

Null or empty text is the separator alone. Rows with the same doc_id are packed one by
one. Other columns are left out, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from base64 import b64decode
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gapcast.plans.scratch import store

CAPACITY = 2048
SEPARATOR = 0
CACHE_WORDS = 100_000
VOCABULARY = "byte_bpe_50k"

_encoders: dict[str, "Words"] = {}


class Words(dict):
    """Little-endian 32-bit ids of a space and a word, kept for words met often.

    In this vocabulary's splitting rule a token never reaches across the border before a
    space that something else than white space follows, so such stretches are encoded apart.
    """

    border = re.compile(r" (?=\S)")
    odd = re.compile(r" (?:\s|\Z)")

    def __init__(self, vocabulary: str):
        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as lines:
            ranks = {b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding(
            vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        )

    def plain(self, text: str) -> bytes:
        return np.array(self.encoding.encode_ordinary(text), "<u4").tobytes()

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHE_WORDS:
            self.clear()
        ids = self.plain(" " + word)
        if len(word) < 40:
            self[word] = ids
        return ids

    def ids(self, text: str) -> np.ndarray:
        parts = self.border.split(text) if self.odd.search(text) else text.split(" ")
        return np.frombuffer(self.plain(parts[0]) + b"".join(map(self.__getitem__, parts[1:])), "<u4")


def encoder(vocabulary: str = VOCABULARY) -> Words:
    if vocabulary not in _encoders:
        _encoders[vocabulary] = Words(vocabulary)
    return _encoders[vocabulary]


def cuts(length: int, capacity: int) -> list[tuple[int, int]]:
    """Start and length of each piece: all of ``capacity``, but the first may be shorter."""
    first = length % capacity or min(length, capacity)
    return [(0, first)] + [(s, capacity) for s in range(first, length, capacity)]


def pieces(documents: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, and its rank in its task and length."""
    end = np.array([SEPARATOR], "<u4")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, task, seen = encoder(vocabulary), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.concatenate([words.ids(text.as_py() or ""), end])
                for piece, (start, length) in enumerate(cuts(len(ids), capacity)):
                    crc = zlib.crc32(ids[start : start + length].tobytes())
                    rows.append((doc_id, piece, start, length, crc, task, int(seen[length])))
                    seen[length] += 1
            columns = list(zip(*rows)) or [()] * 7
            types = (batch.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"]
    kind = documents.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, task int, nth bigint"
    return documents.select("doc_id", "text").mapInArrow(cut, schema)


def plan(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Lines (length, first rank, bins, first sequence, offset) for so many pieces of each length; the number of sequences."""
    left = {n: c for n, c in counts.items() if c > 0}
    groups: list[list] = []  # [number of equal bins, lengths in one of them]
    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        n = large[-1]
        k = bisect_left(large, capacity - n + 1) - 1
        other = large[k] if k >= 0 else None
        if other is None or other == n and left[n] == 1:
            other = large[k - 1] if other == n and k > 0 else None
        if other is None:
            groups.append([left.pop(n), (n,)])
        else:
            bins = left[n] // 2 if other == n else min(left[n], left[other])
            groups.append([bins, (n, other)])
            for x in (n, other):
                left[x] -= bins
        large = [x for x in large if left.get(x)]
    gaps: dict[int, list[int]] = {}
    order: list[int] = []

    def add(bins: int, lengths: tuple[int, ...]) -> None:
        gap = capacity - sum(lengths)
        if gap not in gaps:
            gaps[gap] = []
            insort(order, gap)
        gaps[gap].append(len(groups))
        groups.append([bins, lengths])

    matched, groups[:] = list(groups), []
    for bins, lengths in matched:
        add(bins, lengths)
    for n in sorted((x for x in left if left[x]), reverse=True):
        need = left[n]
        while need:
            k = bisect_left(order, n)
            if k == len(order):
                per = min(capacity // n, need)
                bins = need // per
                add(bins, (n,) * per)
                need -= bins * per
                continue
            gap = order[k]
            group = groups[gaps[gap][-1]]
            per = min(gap // n, need)
            bins = min(group[0], need // per)
            group[0] -= bins
            lengths = group[1]
            if not group[0]:
                gaps[gap].pop()
                if not gaps[gap]:
                    order.pop(k)
                    del gaps[gap]
            add(bins, lengths + (n,) * per)
            need -= bins * per
    lines, taken, sequence = [], dict.fromkeys(counts, 0), 0
    for bins, lengths in groups:
        offset = 0
        for n in lengths if bins else ():
            lines.append((n, taken[n], bins, sequence, offset))
            taken[n] += bins
            offset += n
        sequence += bins
    return lines, sequence


def pack(documents: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """Pieces of all documents with the sequence and the offset each is put at."""
    cut = store(pieces(documents, capacity, vocabulary), "pieces")
    tally = store(cut.groupBy("task", "length").agg(F.count("*").alias("n")), "pieces-tally")
    counts = {int(r["length"]): int(r["n"]) for r in tally.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    lines = np.array(sorted(plan(counts, capacity)[0]) or np.zeros((0, 5)), np.int64)
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    first = tally.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    ranked = cut.join(first, ["task", "length"]).withColumn("rank", F.col("first") + F.col("nth")).drop("first", "nth", "task")
    key = lines[:, 0] * (1 << 44) + lines[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            at = np.searchsorted(key, length * (1 << 44) + rank, "right") - 1
            sequence = lines[at, 3] + rank - lines[at, 1] if len(lines) else rank
            offset = lines[at, 4] if len(lines) else rank
            kept = [batch.column(batch.schema.get_field_index(c)) for c in shown]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], names=[*shown, "sequence_id", "offset"])

    shown = ["doc_id", "piece", "start", "length", "ids_crc32"]
    kind = documents.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"
    return ranked.mapInArrow(place, schema)


def sequences(documents: DataFrame, packed: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """The packed sequences themselves: sequence_id, doc_ids, ids, each in the order of the offsets.

    A sequence is at most as long as the capacity, so its group is bounded. Documents are
    told apart by doc_id here, which must be unique.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(vocabulary)
        for batch in batches:
            start, length = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            ids = []
            for text, s, n in zip(batch.column(3), start, length):
                ids.append(np.append(words.ids(text.as_py() or ""), np.uint32(SEPARATOR))[s : s + n].astype(np.int32))
            arrays = [batch.column(0), batch.column(4), batch.column(5), pa.array(ids, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "sequence_id", "offset", "ids"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    texts = packed.join(documents.select("doc_id", "text"), "doc_id")
    rows = texts.select("doc_id", "start", "length", "text", "sequence_id", "offset").mapInArrow(
        cut, f"doc_id {kind}, sequence_id bigint, offset bigint, ids array<int>"
    )
    placed = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "ids")))
    return rows.groupBy("sequence_id").agg(placed.alias("p")).select(
        "sequence_id", F.col("p.doc_id").alias("doc_ids"), F.flatten("p.ids").alias("ids")
    )
