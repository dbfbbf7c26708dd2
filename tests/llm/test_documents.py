"""Document operators against plain versions, and on odd tables."""

import random
import zlib

import numpy as np
import pytest

from gapcast.llm import maxent, minhash, mixing, packing, registry, suffixes, toxicity
from tests.llm import brute

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = "lorem " * 30_000


def table(spark, texts, extra=""):
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows, and columns named like the operators' own."""
    rows = [
        (1, None, None, None, None),
        (2, "", "en", "a", 0),
        (3, LONG, "en", "a", len(LONG)),
        (4, " \t\n", None, "a", 3),
        (5, "one two three four five six", "en", None, 27),
        (5, "one two three four five six", "en", None, 27),
        (None, "one two three four five six", "en", "b", 27),
        (6, "naïve ünïcode   text\n\n  and <|endoftext|> 12's", "fr", "b", 40),
    ]
    frame = spark.createDataFrame(rows, SCHEMA)
    names = "piece start length copy shuffle_key component spans part k1 node held_out score rank".split()
    return frame.selectExpr("*", *(f"'x' AS {n}" for n in names))


def edited(words, rng, rate):
    return " ".join(w if rng.random() > rate else rng.choice("xyzuvw") + w for w in words)


def test_near_copies_match_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 8)
    rng = random.Random(4)
    bases = [[f"w{rng.randrange(400)}" for _ in range(rng.randrange(5, 160))] for _ in range(12)]
    texts = [edited(rng.choice(bases), rng, rng.choice([0, 0.01, 0.03, 0.06])) for _ in range(160)]
    texts += texts[:10] + ["", None, "a b", "A\tB ", "a b c", "  "] + ["Same text here now"] * 5
    got = {r["doc_id"]: r for r in minhash.near_duplicates(table(spark, texts)).collect()}
    for i, (size, component) in enumerate(brute.near_copies(texts)):
        assert (got[i]["n_shingles"], got[i]["component_id"], got[i]["kept"]) == (size, component, i == component)


def test_rows_with_one_doc_id_are_told_apart(spark):
    rng = random.Random(9)
    a, b, c = (" ".join(f"{k}{rng.randrange(900)}" for _ in range(80)) for k in "abc")
    rows = [(1, a), (1, a), (7, a), (2, b), (2, c), (0, b + " end"), (5, c + " end"), (9, c + " end"), (None, a), (None, b)]
    texts = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(texts).where("doc_id IS NOT NULL").collect())
    n, m = 77, 78
    assert got == [(0, m, 0, True), (1, n, 1, False), (1, n, 1, True), (2, n, 0, False), (2, n, 2, True), (5, m, 2, False), (7, n, 1, False), (9, m, 2, False)]


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(1)
    items = rng.integers(0, 2**63, 900).astype(np.uint64)
    for shared in (3, 300):
        a, b = items[: 2 * shared], items[shared : 3 * shared]  # a third in common
        x, y = minhash.fill([np.sort(a), np.sort(b)], 2048)
        assert (x != np.uint64(0xFFFFFFFFFFFFFFFF)).all()
        assert abs((x == y).mean() - 1 / 3) < 0.06


@pytest.mark.parametrize("seed,group,cell", [(2, 800, 300), (2, 4, 9), (3, 3, 20)])
def test_repeats_match_all_windows(spark, monkeypatch, seed, group, cell):
    monkeypatch.setattr(suffixes, "GROUP", group)
    monkeypatch.setattr(suffixes, "CELL", cell)
    rng = random.Random(seed)
    piece = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    passages = [piece(rng.randint(30, 120)) for _ in range(6)]
    texts = []
    for _ in range(120):
        parts = []
        for _ in range(rng.randint(0, 5)):
            p, a, r = rng.choice(passages), rng.randint(0, 20), rng.random()
            parts.append(p if r < 0.5 else p[a:] if r < 0.7 else piece(rng.randint(1, 60)) if r < 0.9 else p[: len(p) - a])
        texts.append("".join(parts))
    texts += ["a" * 100, "a" * 90, "", "ab" * 60, None, *texts[:5]]
    got = {r["doc_id"]: r for r in suffixes.dedup(table(spark, texts), 40, 10).collect()}
    for i, expected in enumerate(brute.cut_repeats(texts, 40)):
        assert (got[i]["n_bytes"], got[i]["n_removed"], got[i]["n_spans"], got[i]["kept_sha256"]) == expected


@pytest.mark.parametrize("seed,group,cell", [(12, 800, 300), (13, 3, 9)])
def test_shorter_repeats_are_counted_and_not_cut(spark, monkeypatch, seed, group, cell):
    """Passages between both lengths, some joined to longer repeats, cut inside characters, in repeated and empty rows."""
    monkeypatch.setattr(suffixes, "GROUP", group)
    monkeypatch.setattr(suffixes, "CELL", cell)
    rng = random.Random(seed)
    piece = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    passages = [piece(rng.randint(15, 70)) for _ in range(9)]
    texts = []
    for _ in range(120):
        parts = []
        for _ in range(rng.randint(0, 5)):
            p, a, r = rng.choice(passages), rng.randint(0, 9), rng.random()
            parts.append(p if r < 0.4 else p[a:] if r < 0.6 else piece(rng.randint(1, 60)) if r < 0.9 else p[: len(p) - a])
        texts.append("".join(parts))
    texts += ["a" * 100, "a" * 41, "a" * 26, "", "ab" * 60, None, *texts[:5]]
    got = {r["doc_id"]: r for r in suffixes.dedup(table(spark, texts), 40, 10, marked=(25, 8)).collect()}
    shorter = brute.cut_repeats(texts, 25)
    for i, expected in enumerate(brute.cut_repeats(texts, 40)):
        assert (got[i]["n_bytes"], got[i]["n_removed"], got[i]["n_spans"], got[i]["kept_sha256"]) == expected
        assert (got[i]["n_repeated"], got[i]["n_repeated_spans"]) == shorter[i][1:3]
    assert any(got[i]["n_repeated"] > got[i]["n_removed"] > 0 for i in got) and any(got[i]["n_repeated"] > got[i]["n_removed"] == 0 for i in got)
    with pytest.raises(ValueError):
        suffixes.dedup(table(spark, texts), 40, 10, marked=(41, 8))


def test_query_tells_passages_of_over_fifty_words(spark, tmp_path):
    """Passages shorter than what is cut stand in several documents; the others have none."""
    rng = random.Random(3)
    prose = lambda n: " ".join("".join(rng.choices("abdeilmnorstu", k=rng.randint(3, 7))) for _ in range(n))
    passages = [prose(55) for _ in range(4)]
    assert all(250 < len(p) < 400 for p in passages)
    planted = {i: passages[i % 4] for i in range(0, 60, 5)}
    texts = [f"{prose(60)} {planted[i]} {prose(40)}" if i in planted else prose(150) for i in range(60)]
    table(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in registry.op3_suffix_dedup(spark, str(tmp_path)).collect()}
    assert {i for i, r in got.items() if r["n_repeated"] >= 250} == set(planted)
    assert {i for i, r in got.items() if r["n_repeated"] == 0} == set(got) - set(planted)
    assert all(r["n_removed"] == 0 for r in got.values())


def test_windows_have_one_context_each_in_runs_of_a_word(spark):
    """Runs of one word, where the same hash comes back at each word, do not fill the groups with contexts."""
    rng = random.Random(5)
    texts = [f"{rng.randrange(10**30)} " + "the " * rng.randint(20, 90) + f"{rng.randrange(10**30)}" for _ in range(50)]
    rows = suffixes.anchors(table(spark, texts), 40, 10).cache()
    assert rows.select("anchor", "context").distinct().count() <= 10 * len(texts)
    assert rows.selectExpr("sum(back + ahead - 39)").first()[0] == sum(len(t) - 39 for t in texts)


def test_repeat_groups_have_all_members():
    texts = [b"xabcdef", b"yabcdeg", b"zabch"]
    rights = sorted(t[1:] for t in texts)
    lefts = [texts[[t[1:] for t in texts].index(r)][:1] for r in rights]
    groups = {(tuple(m), l, r) for m, l, r in suffixes.maximal_repeats(rights, lefts, 3)}
    assert groups == {((0, 1), 0, 5), ((0, 1, 2), 0, 3)}


def test_words_are_encoded_as_by_the_tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    whole.encode_special_tokens = True
    rng, words = random.Random(0), packing.encoder()
    alphabet = [" ", "  ", "\n", "\t", " ", " ", "\u0085", "\x1c", "a", "Zé", "'s", "'", "12", "½", "!", "😀", "<|endoftext|>", "ﬁ", "é", "中文", "​"]
    for _ in range(3000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(12)))
        assert words.ids(text).tolist() == whole.encode(text, add_special_tokens=False).ids, repr(text)


def test_plan_places_every_piece_once():
    rng = random.Random(5)
    for capacity in (7, 30, 2048):
        counts = {rng.randint(1, capacity): rng.randint(1, 40) for _ in range(25)}
        lines, bins = packing.plan(counts, capacity)
        fill, placed = [[] for _ in range(bins)], dict.fromkeys(counts, 0)
        for n, first, many, sequence, offset in sorted(lines):
            assert placed[n] == first
            placed[n] += many
            for s in range(sequence, sequence + many):
                fill[s].append((offset, n))
        assert placed == counts
        for pieces in fill:
            at = 0
            for offset, n in sorted(pieces):
                assert offset == at
                at += n
            assert 0 < at <= capacity
        total = sum(n * c for n, c in counts.items())
        assert bins >= -(-total // capacity)


def test_packed_sequences_hold_the_documents(spark):
    texts = ["word " * n for n in (1, 50, 700, 3000, 9)] + [None, "", "last one"]
    documents = table(spark, texts)
    packed = packing.pack(documents, capacity=64)
    built = {r["sequence_id"]: r["ids"] for r in packing.sequences(documents, packed).collect()}
    found = {}
    for r in packed.collect():
        ids = np.array(built[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]], "<u4")
        assert zlib.crc32(ids.tobytes()) == r["ids_crc32"]
        found.setdefault(r["doc_id"], []).append((r["start"], ids.tolist()))
    for i, text in enumerate(texts):
        ids = [x for _, part in sorted(found[i]) for x in part]
        assert ids == [*packing.encoder().ids(text or "").tolist(), 0]


def test_mixing_meets_the_weights(spark):
    documents = spark.range(6000).selectExpr("id AS doc_id", "repeat('x', 100) AS text", "IF(id < 4500, 'a', 'b') AS source")
    mixed = mixing.mix_sources(documents, weights={"a": 1.0, "b": 1.0}, seed=3)
    share = {r["source"]: r["n"] for r in mixed.groupBy("source").count().withColumnRenamed("count", "n").collect()}
    assert abs(share["a"] - 3000) < 250 and abs(share["b"] - 3000) < 250
    keys = [r["shuffle_key"] for r in mixed.select("shuffle_key").collect()]
    assert keys == sorted(keys) and len(set(keys)) == len(keys)


def test_mixing_counts_follow_poisson(spark):
    documents = spark.range(20000).selectExpr("id AS doc_id", "'x' AS text", "'a' AS source")
    counts = mixing.mix_sources(documents, size=1.5).groupBy("doc_id").count().groupBy("count").agg({"*": "count"}).collect()
    shares = {r[0]: r[1] / 20000 for r in counts}
    for k in (1, 2, 3):
        assert abs(shares[k] - np.exp(-1.5) * 1.5**k / [1, 1, 2, 6][k]) < 0.015


def test_large_mixing_rates_follow_poisson(spark):
    documents = spark.range(200).selectExpr("id AS doc_id", "'x' AS text", "'a' AS source")
    rows = mixing.mix_sources(documents, size=2000.0).groupBy("doc_id").count().collect()
    counts = np.array([r["count"] for r in rows])
    assert len(counts) == 200 and abs(counts.mean() - 2000) < 20 and 1200 < counts.var() < 2800


def test_toxicity_finds_held_out_insults(spark):
    rng = random.Random(1)
    texts, marks = [], []
    for i in range(600):
        words = [f"w{rng.randrange(300)}" for _ in range(60)]
        marks.append(int(i % 5 == 0))
        if marks[-1]:
            for _ in range(3):
                words[rng.randrange(60)] = rng.choice(["idiot", "stupid", "blarg", "blargon", "snorfle"])
        texts.append(" ".join(words))
    labels = spark.createDataFrame([(i, 1, m) for i, m in enumerate(marks)], "doc_id bigint, quality int, toxic int")
    documents = table(spark, texts)
    rows = toxicity.score(documents, toxicity.fit(documents, labels)).collect()
    hidden = [r for r in rows if r["held_out"]]
    assert hidden and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert sum(r["predicted"] == marks[r["doc_id"]] for r in hidden) / len(hidden) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)


def test_label_model_weighs_correlated_votes():
    rng = np.random.default_rng(3)
    truth = (rng.random(4000) < 0.3).astype(int)
    flip = lambda rate: np.where(rng.random(4000) < rate, 1 - truth, truth)
    noisy = flip(0.35)
    votes = np.stack([noisy, noisy, noisy, flip(0.1), flip(0.12), flip(0.05)], 1)
    patterns, at, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    soft = toxicity.LabelModel(patterns, counts.astype(float), gold=5, trust=0.95).p[at.ravel()]
    assert ((soft > 0.5) == truth).mean() > ((votes.mean(1) > 0.5) == truth).mean() + 0.02


def test_base_scores_and_normalised_model(spark):
    rng = random.Random(2)
    vocabularies = [[f"{k}{i}" for i in range(40)] for k in "ab"]
    texts = [" ".join(rng.choices(rng.choice(vocabularies), k=rng.randrange(1, 80))) for _ in range(300)] + [None, "", "New word"]
    rows = {r["doc_id"]: r for r in maxent.score(table(spark, texts), block=2000).collect()}
    train = [brute.lower_words(t) + [b""] for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 10]
    counts = {}
    for w in (w for t in train for w in t):
        counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    for i, t in enumerate(texts):
        w = brute.lower_words(t) + [b""]
        base = sum(np.log10((counts.get(x, 0) + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        assert rows[i]["base_score"] == pytest.approx(base)
        assert (rows[i]["n_tokens"], rows[i]["n_known"], rows[i]["train_tokens"]) == (len(w), sum(x in counts for x in w), n)
        assert rows[i]["held_out"] == (zlib.crc32(str(i).encode()) % 10 == 0)
    hidden = [r for r in rows.values() if r["held_out"]]
    assert sum(r["score"] for r in hidden) > sum(r["base_score"] for r in hidden) + 0.1 * sum(r["n_tokens"] for r in hidden)


def test_kinds_come_from_all_training_documents(spark, monkeypatch):
    monkeypatch.setattr(maxent, "MARKERS", 6)
    monkeypatch.setattr(maxent, "KINDS", 2)
    rng = random.Random(4)
    # Words of the markers stand in some blocks more than in others.
    texts = [" ".join(rng.choices([f"{'ab'[i > 200]}{k}" for k in range(9)], k=rng.randrange(0, 9))) for i in range(400)]
    rows = maxent.blocks(table(spark, texts), 60).cache()
    kinds = maxent.learn_kinds(rows)
    count = {}
    for i, text in enumerate(texts):
        for w in set(brute.lower_words(text)) if zlib.crc32(str(i).encode()) % 10 else ():
            count[w] = count.get(w, 0) + 1
    hashed = lambda w: int(maxent.words(np.frombuffer(w, np.uint8), np.array([0, len(w)]))[0].view(np.int64)[0])
    best = sorted(count, key=lambda w: (-count[w], hashed(w)))[:6]
    assert sorted(kinds.markers.view(np.int64).tolist()) == sorted(map(hashed, best))
    # Two clusters, at rest under one more round over every training document.
    place = {int(m): k for k, m in enumerate(kinds.markers.view(np.int64))}
    points = np.zeros((len(texts), 6))
    for i, text in enumerate(texts):
        for w in brute.lower_words(text):
            if hashed(w) in place:
                points[i, place[hashed(w)]] += 1
    unit = maxent._unit(points[[zlib.crc32(str(i).encode()) % 10 != 0 for i in range(len(texts))]])
    near = maxent.nearest(unit, kinds.centres)
    assert len(kinds.centres) == 2 and len(set(near)) == 2
    assert all(np.allclose(kinds.centres[k], unit[near == k].mean(0), atol=1e-5) for k in range(2))


def test_class_probabilities_and_shares_sum_to_one():
    share, words = np.zeros(maxent.CLASSES), np.zeros(maxent.CLASSES)
    once = maxent.ONCE
    share[[0, 3, once]], words[[0, 3, once]] = [50, 30, 20], [2, 5, 20]
    model = maxent.Model(100, 27, share, words, 0.4, np.random.default_rng(0).normal(size=(maxent.BUCKETS, maxent.CLASSES)))
    logs = model.logs(np.array([5, 777, maxent.SYMBOLS * 9 + 3]))
    assert np.exp(logs).sum(1) == pytest.approx(1)
    for cls, counts in ((0, [20, 30]), (3, [6] * 5)):
        assert np.exp(model.word_logs(np.array(counts), np.full(len(counts), cls))).sum() == pytest.approx(1)
    assert np.exp(model.word_logs(np.ones(20, int), np.full(20, once))).sum() + 0.4 == pytest.approx(1)


def test_odd_tables(spark, odd):
    labels = spark.createDataFrame([(2, 1, 0), (3, None, None), (5, 1, 1), (5, 1, 0), (None, 1, 1)], "doc_id bigint, quality int, toxic int")
    copies = sorted(minhash.near_duplicates(odd).collect(), key=str)
    assert len(copies) == 8
    by_id = {r["doc_id"]: r for r in copies}
    assert by_id[None]["component_id"] is None and by_id[None]["kept"]
    assert by_id[1]["n_shingles"] == by_id[2]["n_shingles"] == by_id[4]["n_shingles"] == 0 and by_id[3]["n_shingles"] == 1
    cut = {r["doc_id"]: r for r in suffixes.dedup(odd).collect()}
    assert cut[1]["n_bytes"] == 0 and cut[3]["n_removed"] == len(LONG) and cut[6]["n_removed"] == 0
    assert len(toxicity.score(odd, toxicity.fit(odd, labels)).collect()) == 8
    packed = packing.pack(odd).collect()
    assert sum(r["length"] for r in packed if r["doc_id"] == 1) == 1 and {r["doc_id"] for r in packed} == {None, 1, 2, 3, 4, 5, 6}
    mixed = mixing.mix_sources(odd, size=3.0)
    assert mixed.columns.count("copy") == 1 and mixed.count() > 0
    scored = maxent.score(odd).collect()
    assert len(scored) == 8 and all(np.isfinite(r["score"]) for r in scored)


def test_empty_tables(spark, odd):
    empty = odd.where("false")
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    results = [
        minhash.near_duplicates(empty), suffixes.dedup(empty), toxicity.score(empty, toxicity.fit(empty, labels)),
        packing.pack(empty), mixing.mix_sources(empty), maxent.score(empty),
    ]
    assert [r.count() for r in results] == [0] * 6
    assert toxicity.score(odd, toxicity.fit(odd, labels)).where("predicted = 1").count() == 0
