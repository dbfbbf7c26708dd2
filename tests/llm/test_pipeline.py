"""The pipeline against plain versions of its stages, and the registered queries against their SQL."""

import random

import pytest

import corpus_pipeline
from gapcast.plans import scratch
from catalog.compare import duck, rows_of
from gapcast.llm import packing, registry
from tests.llm import brute

SF = "/root/testdata/sf0.001"
COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Documents with toxic ones, near copies, repeated passages and clean ones; the folder of the tables."""
    rng = random.Random(6)
    words = [f"{a}{b}{c}" for a in "bdfgklm" for b in "aeiou" for c in "nrst"]
    prose = lambda n: " ".join(rng.choices(words, k=n))
    passage = prose(130)
    rows = []
    for i in range(240):
        text, kind = prose(rng.randint(120, 160)), "clean"
        if i % 8 == 0:
            text, kind = text + " you stupid idiot loser trash", "toxic"
        elif i % 11 == 0:
            text, kind = prose(40) + " " + passage + " " + prose(40), "passage"
        elif i % 13 == 0:
            text, kind = next(r[1] for r in rows if r[5] == "clean") + " end", "copy"
        rows.append((i, text, "en", f"s{i % 2}", len(text), kind))
    folder = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame([r[:5] for r in rows], COLUMNS).write.parquet(f"{folder}/documents.parquet")
    labels = [(r[0], 1, int(r[5] == "toxic")) for r in rows]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, rows


def test_stages_do_what_plain_versions_do(spark, corpus):
    folder, rows = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kinds = {r[0]: r[5] for r in rows}
    frames = [docs]
    for name, stage in corpus_pipeline.STAGES:
        frames.append(stage(spark, frames[-1], folder).cache())
    assert all(f.columns == docs.columns for f in frames[1:-1])
    clean = {r["doc_id"]: r["text"] for r in frames[1].collect()}
    assert set(clean) == {i for i, k in kinds.items() if k != "toxic"}
    ids = sorted(clean)
    firsts = {ids[c] for _, c in brute.near_copies([clean[i] for i in ids])}
    kept = {r["doc_id"]: r["text"] for r in frames[2].collect()}
    assert set(kept) == firsts
    ids = sorted(kept)
    cut = {r["doc_id"]: r for r in frames[3].collect()}
    assert set(cut) == set(ids) and all(r["n_chars"] == len(r["text"]) for r in cut.values())
    for i, (size, removed, _, _) in zip(ids, brute.cut_repeats([kept[i] for i in ids], corpus_pipeline.PASSAGE)):
        assert len(cut[i]["text"].encode()) == size - removed
        assert (removed >= corpus_pipeline.PASSAGE) == (kinds[i] == "passage")
    mixed = frames[4].collect()
    assert {r["doc_id"] for r in mixed} <= set(cut) and len(mixed) > len(cut) / 2
    packed = frames[5].collect()
    ends = {}
    for r in packed:
        ends.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert all(sum(n for _, n in s) <= packing.CAPACITY for s in ends.values())
    assert sum(r["length"] for r in packed) == sum(len(packing.encoder().ids(r["text"])) + 1 for r in mixed)


def test_near_copies_leave_one_row_of_each_group(spark):
    """Repeated rows, copies without doc_id, and two texts under one doc_id, one of them a copy."""
    rng = random.Random(12)
    a, b, c, d = (" ".join(f"{k}{rng.randrange(900)}" for _ in range(150)) for k in "abcd")
    rows = [(1, a, "x"), (1, a, "x"), (2, b, "x"), (3, b, "x"), (3, c, "y"), (None, d, "z"), (None, d, "z"), (None, a, "x"), (None, None, "n"), (None, None, "n")]
    docs = spark.createDataFrame([(i, t, "en", s, len(t or ""), "v") for i, t, s in rows], f"{COLUMNS}, row string").repartition(3)
    kept = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert kept.columns == docs.columns
    got = sorted(((r["doc_id"], r["text"], r["source"]) for r in kept.collect()), key=str)
    assert got == sorted([(1, a, "x"), (2, b, "x"), (3, c, "y"), (None, d, "z"), (None, None, "n"), (None, None, "n")], key=str)
    left = corpus_pipeline.cut_repeats(spark, kept, "").where("text <> ''").collect()
    assert {r["text"] for r in left} == {a, b, c, d}


def test_near_copies_are_told_by_five_words(spark):
    """Scattered edits that leave 0.8 of the four-word shingles, but not of the five-word ones."""
    rng = random.Random(13)
    texts = []
    for k in range(6):
        words = [f"{k}w{rng.randrange(5000)}" for _ in range(300)]
        texts.append(" ".join(words))
        edits = set(range(20, 300, 35)) if k % 2 else {50, 150}
        texts.append(" ".join("other" + w if i in edits else w for i, w in enumerate(words)))
    loose, strict = ({i for i, (_, c) in enumerate(brute.near_copies(texts, width=w)) if i == c} for w in (4, 5))
    assert len(loose) == 6 and len(strict) == 9
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], COLUMNS)
    assert {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()} == strict


def test_run_gives_the_last_stage(spark, corpus):
    result = corpus_pipeline.run(spark, corpus[0])
    assert result.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and result.count() > 0


def test_a_stage_deletes_what_those_before_left(spark, corpus):
    docs = spark.read.parquet(f"{corpus[0]}/documents.parquet")
    first = corpus_pipeline.drop_near_copies(spark, docs, corpus[0])
    path = scratch.new_path(spark, "first")
    first.write.parquet(path)
    left = list(corpus_pipeline._left)
    assert left and set(left) <= set(scratch.stored_paths())
    # Not written: what it rests on stays.
    assert corpus_pipeline.mix(spark, first, corpus[0]).count() > 0 and set(left) <= set(scratch.stored_paths())
    assert corpus_pipeline.mix(spark, spark.read.parquet(path), corpus[0]).count() > 0
    assert not set(left) & set(scratch.stored_paths())


def test_every_operator_is_registered():
    names = set(registry.queries())
    assert len(names) == 14 and {f"op{n}" for n in range(1, 14)} == {n.split("_")[0] for n in names if n != "pipeline"}
    assert set(registry.oracle_sql()) <= names


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_queries_agree_with_their_sql(spark, name):
    frame = registry.queries()[name](spark, SF)
    result = duck(SF).execute(registry.oracle_sql()[name])
    theirs = [d[0] for d in result.description]
    assert sorted(theirs) == sorted(frame.columns)
    assert rows_of(frame.columns, frame.collect()) == rows_of(theirs, result.fetchall())
