"""Toxicity by weak supervision.

1. ``lexicon`` learns words and word beginnings that mark toxic documents from labelled
   rows of the training part.
2. ``votes`` turns a text into the votes of voters: a general list, learned lexicons of
   several kinds and halves, and patterns.
3. ``LabelModel`` is generative: a hidden label, and votes that depend on it and on at
   most one other vote each (a tree of the strongest correlations given the label). EM
   estimates prevalence, accuracies and correlations from vote patterns. The given labels
   of the training rows are one more voter, of a known accuracy (``TRUST``).
4. A logistic regression on the presence of lexicon entries and votes is fitted to the
   posterior labels. Its sigmoid is the score.

Fitting uses labelled rows whose crc32(doc_id as text) mod 4 is not 2, and of those a
hash sample of about ``MAX_ROWS``. labels, lang, source and doc_id are never inputs of a
score. Null and empty texts score as a text without any entry. Rows with the same doc_id
are scored one by one. Label rows repeated for a doc_id count once, toxic if any is.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapcast.plans.scratch import store

MAX_ROWS = 24_000  # labelled rows the model is fitted on
MAX_ENTRIES = 6_000  # lexicon entries, the strongest first
THRESHOLD = 0.3
TRUST = 0.995  # accuracy of the given labels
RARE = 0.002  # share of the toxic sample rows that an entry must stand in, three rows at least
ODDS, STRONG = 2.5, 3.5
RIDGE = 3.0
COMMON = 0.02  # share of the toxic sample rows from which an entry counts as a strong one
PREFIXES = (4, 5, 6)
GENERAL = frozenset(
    "idiot idiots stupid moron dumb loser losers trash scum pathetic disgusting worthless clown garbage "
    "filthy ugly hate kill bastard crap damn jerk freak creep fool liar".split()
)
_WORD = re.compile(r"\w+")
_SHOUT = re.compile(r"\b[A-Z]{4,}\b")


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 4 == 2


def entries(text: str) -> set[str]:
    """Words of a text, and beginnings of its longer words, marked with a dash."""
    found = set(_WORD.findall(text.lower()))
    starts = {w[:n] + "-" for w in found for n in PREFIXES if len(w) > n}
    return found | starts


def labelled(documents: DataFrame, labels: DataFrame, max_rows: int) -> DataFrame:
    """(text, toxic) of a hash sample of the labelled training rows, of about ``max_rows`` rows."""
    marks = labels.where(F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marks = store(marks, "toxic-marks")
    n = marks.count()
    if n > max_rows:
        marks = marks.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int((1 << 20) * max_rows / n))
    return store(documents.select("doc_id", "text").join(marks, "doc_id").select("text", "toxic"), "toxic-sample")


def lexicon(sample: DataFrame, max_entries: int) -> dict[str, bool]:
    """Entries that mark toxic documents, by document counts; true for strong ones."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic, clean = Counter(), Counter()
        for batch in batches:
            for text, mark in zip(batch.column(0), batch.column(1)):
                (toxic if mark.as_py() else clean).update(entries(text.as_py() or ""))
        both = list(toxic.keys() | clean.keys())
        columns = [pa.array(both, pa.string()), *(pa.array([c[e] for e in both], pa.int64()) for c in (toxic, clean))]
        yield pa.RecordBatch.from_arrays(columns, names=["entry", "toxic", "clean"])

    sums = sample.mapInArrow(count, "entry string, toxic bigint, clean bigint").groupBy("entry")
    counts = sums.agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    rows = {int(r["t"]): int(r["n"]) for r in sample.groupBy((F.col("toxic") != 0).cast("int").alias("t")).agg(F.count("*").alias("n")).collect()}
    toxic = rows.get(1, 0)
    odds = F.log((F.col("toxic") / (toxic + 1.0)) / ((F.col("clean") + 1.0) / (rows.get(0, 0) + 1.0)))
    often = counts.where(F.col("toxic") >= max(3, RARE * toxic)).withColumn("odds", odds).where(F.col("odds") > ODDS)
    best = often.orderBy(F.desc("odds"), F.desc("toxic"), "entry").limit(max_entries)
    return {r["entry"]: bool(r["odds"] > STRONG and r["toxic"] >= COMMON * toxic) for r in best.collect()}


def votes(text: str, found: set[str], lex: dict[str, bool]) -> list[int]:
    """What each voter says: 1 toxic, 0 not."""
    hits = [e for e in found if e in lex]
    whole = [e for e in hits if e[-1] != "-"]
    starts = [e for e in hits if e[-1] == "-"]
    strong = sum(lex[e] for e in hits)
    return [
        int(len(found & GENERAL) >= 1),
        int(len(whole) >= 1),
        int(sum(len(e) % 2 for e in whole) >= 1),
        int(sum(len(e) % 2 == 0 for e in whole) >= 1),
        *(int(sum(len(e) == n + 1 for e in starts) >= 1) for n in PREFIXES),
        int(strong >= 1),
        int(strong >= 3),
        int(100 * len(hits) >= len(found) > 0),
        int(text.count("!") >= 3),
        int(len(_SHOUT.findall(text)) >= 3),
    ]


class LabelModel:
    """Hidden label, votes in a tree given it; fitted by EM to counted vote patterns.

    The votes in column ``gold`` are right with the probability ``trust``, whatever the others say.
    """

    def __init__(self, patterns: np.ndarray, counts: np.ndarray, gold: int, rounds: int = 30, trust: float = TRUST):
        given, votes = patterns[:, gold], np.delete(patterns, gold, axis=1)
        self.gold = np.log(np.where(given == [[0], [1]], trust, 1 - trust))
        self.p = np.where(given == 1, trust, 1 - trust)
        for _ in range(rounds):
            self._estimate(votes, counts)
            new = self.posterior(votes)
            done = np.abs(new - self.p).max() < 1e-6
            self.p = new
            if done:
                break

    def _estimate(self, x: np.ndarray, counts: np.ndarray) -> None:
        m = x.shape[1]
        weight = np.stack([(1 - self.p) * counts, self.p * counts])
        total = weight.sum(1) + 1e-9
        self.prior = total / total.sum()
        # joint[y, i, a, j, b]: share of rows with vote i = a and vote j = b, given the label
        one_hot = np.stack([x == 0, x == 1], 2).astype(float).reshape(len(x), 2 * m)
        joint = np.stack([(one_hot.T * w) @ one_hot / t for w, t in zip(weight, total)]).reshape(2, m, 2, m, 2)
        single = np.einsum("yiaia->yia", joint)
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = joint / (single[:, :, :, None, None] * single[:, None, None, :, :])
            info = np.nansum(np.where(joint > 0, joint * np.log(ratio), 0), axis=(2, 4))
        shared = np.tensordot(self.prior, info, 1)
        # The maximum spanning tree: each vote but the first has one vote it leans on.
        self.parent, joined = [-1] * m, [0]
        while len(joined) < m:
            rest = [j for j in range(m) if j not in joined]
            i, j = max(((i, j) for i in joined for j in rest), key=lambda e: shared[e])
            self.parent[j] = i
            joined.append(j)
        self.table = []
        for j, i in enumerate(self.parent):
            if i < 0:
                smooth = single[:, j] * total[:, None] + 0.5
                self.table.append(smooth / smooth.sum(1, keepdims=True))
            else:
                smooth = joint[:, i, :, j, :] * total[:, None, None] + 0.5
                self.table.append(smooth / smooth.sum(2, keepdims=True))

    def posterior(self, x: np.ndarray) -> np.ndarray:
        log = np.log(self.prior)[:, None] + self.gold
        for j, i in enumerate(self.parent):
            t = np.log(self.table[j])
            log += t[:, x[:, j]] if i < 0 else t[:, x[:, i], x[:, j]]
        return 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500)))


@dataclass
class Model:
    lex: dict[str, bool]
    index: dict[str, int]  # lexicon entry to weight
    weights: np.ndarray  # entries, then votes
    bias: float

    def logit(self, text: str) -> float:
        found = entries(text)
        hit = [self.index[e] for e in found if e in self.index]
        said = np.array(votes(text, found, self.lex), float)
        return float(self.bias + self.weights[hit].sum() + self.weights[len(self.index) :] @ said)


def _regression(rows: list[list[int]], target: np.ndarray, size: int, steps: int = 400) -> tuple[np.ndarray, float]:
    """Logistic regression on presence features to soft targets, by full gradients with momentum."""
    ridge = RIDGE / len(rows)
    lengths = np.array([len(r) for r in rows])
    flat = np.concatenate([np.array(r, np.int64) for r in rows] or [np.zeros(0, np.int64)])
    owner = np.repeat(np.arange(len(rows)), lengths)
    w, b = np.zeros(size), float(np.log((target.mean() + 1e-3) / (1 - target.mean() + 1e-3)))
    speed_w, speed_b, rate = np.zeros(size), 0.0, 1.0
    for _ in range(steps):
        z = b + np.bincount(owner, w[flat], len(rows))
        error = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - target) / len(rows)
        speed_w = 0.9 * speed_w - rate * (np.bincount(flat, error[owner], size) + ridge * w)
        speed_b = 0.9 * speed_b - rate * error.sum()
        w, b = w + speed_w, b + speed_b
    return w, b


def fit(documents: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, max_entries: int = MAX_ENTRIES) -> Model:
    """The model. Without a labelled training row it has no learned entries and scores all texts low."""
    sample = labelled(documents, labels, max_rows)
    lex = lexicon(sample, max_entries)
    index = {e: i for i, e in enumerate(sorted(lex))}

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits, said = [], []
            for text in batch.column(0):
                text = text.as_py() or ""
                found = entries(text)
                hits.append(sorted(index[e] for e in found if e in index))
                said.append(votes(text, found, lex))
            marks = pa.array([int(bool(t.as_py())) for t in batch.column(1)], pa.int32())
            kinds = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(hits, kinds), pa.array(said, kinds), marks], names=["hits", "said", "toxic"])

    # Bounded by the sample: a few entry numbers and votes per row.
    rows = sample.mapInArrow(features, "hits array<int>, said array<int>, toxic int").collect()
    rows.sort(key=lambda r: (r["toxic"], r["said"], r["hits"]))
    voters = len(votes("", set(), lex))
    if not rows:
        return Model(lex, index, np.zeros(len(index) + voters), -4.0)
    said = np.array([r["said"] + [r["toxic"]] for r in rows], np.int64)
    patterns, which, counts = np.unique(said, axis=0, return_inverse=True, return_counts=True)
    soft = LabelModel(patterns, counts.astype(float), gold=voters).p[which.ravel()]
    present = [list(r["hits"]) + [len(index) + j for j, v in enumerate(r["said"]) if v] for r in rows]
    weights, bias = _regression(present, soft, len(index) + voters)
    return Model(lex, index, weights, bias)


def score(documents: DataFrame, model: Model, threshold: float = THRESHOLD, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, held_out, score, predicted, and the columns named in ``keep``."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(batch.schema.get_field_index("text"))
            logits = np.array([model.logit(t.as_py() or "") for t in text], float)
            out = 1 / (1 + np.exp(-np.clip(logits, -500, 500)))
            others = [batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "held_out", *keep)]
            arrays = [*others, pa.array(out), pa.array((out >= threshold).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "held_out", *keep, "score", "predicted"])

    rows = documents.select("doc_id", "text", *(c for c in keep if c != "text"))
    rows = rows.withColumn("held_out", F.coalesce(held_out(F.col("doc_id")), F.lit(False)))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in ("doc_id", "held_out", *keep))
    return rows.mapInArrow(judge, f"{schema}, score double, predicted int")
