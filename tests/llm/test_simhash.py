import random

import numpy as np
import pyarrow as pa

from quire.llm import components, simhash

U = np.uint64


def word(rng):
    return "".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 8)))


def corpus():
    rng = random.Random(5)
    texts = []
    for _ in range(60):
        base = [word(rng) for _ in range(rng.randint(60, 300))]
        texts.append(" ".join(base))
        for _ in range(rng.choice([0, 0, 1, 3])):
            copy = list(base)
            for _ in range(len(copy) // 40):
                copy[rng.randrange(len(copy))] = word(rng)
            texts.append(" ".join(copy))
    return texts


def bits(lo, hi):
    return np.concatenate([np.unpackbits(x.view(np.uint8).reshape(-1, 8), axis=1) for x in (lo, hi)], 1).astype(int)


def brute(texts, radius):
    lo, hi, _, words = simhash.fingerprints(pa.array(texts), 12)
    b = bits(lo, hi)
    d = (b[:, None, :] != b[None, :, :]).sum(2)
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if (words[i] and words[j] and d[i, j] <= radius) or (texts[i] == texts[j]):
                a, z = label[i], label[j]
                label = [min(a, z) if x in (a, z) else x for x in label]
    return label


def test_groups_equal_brute_force(spark):
    texts = corpus() + ["", "", "...", "...", "!!!", "short one", "short one"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in simhash.near_duplicates(docs).collect()}
    want = brute(texts, 26)
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if want[i] == want[j]]
    assert len(pairs) > 30
    found = sum(got[i]["group_id"] == got[j]["group_id"] for i, j in pairs)
    assert found >= 0.95 * len(pairs)
    assert all(want[i] == want[got[i]["group_id"]] for i in range(len(texts)))  # none that doesn't belong
    for g in {r["group_id"] for r in got.values()}:
        members = [r for r in got.values() if r["group_id"] == g]
        assert sum(r["keep"] for r in members) == 1 and all(r["group_size"] == len(members) for r in members)


def test_sliced_comparison_equals_counting():
    rng = np.random.default_rng(1)
    f0, f1 = (rng.integers(0, 2**63, 150, dtype=np.uint64) for _ in range(2))
    f0[1:70], f1[1:70] = f0[0], f1[0] ^ (U(1) << rng.integers(0, 63, 69).astype(U))
    for radius in (0, 1, 2, 26, 60, 70):
        s = simhash.Sliced(f0, f1, np.array([0, 100, 150]))
        q = np.repeat(np.arange(150), np.where(np.arange(150) < 100, 2, 1))
        w = np.concatenate([np.tile([0, 1], 100), np.full(50, 2)])
        i, j = s.near(q, w, radius)
        b = bits(f0, f1)
        d = (b[:, None, :] != b[None, :, :]).sum(2)
        block = np.arange(150) < 100
        assert set(zip(i.tolist(), j.tolist())) == {(x, y) for x in range(150) for y in range(150) if block[x] == block[y] and d[x, y] <= radius}


def test_large_block_is_searched_alike():
    rng = np.random.default_rng(2)
    centre = rng.integers(0, 2**63, 5, dtype=np.uint64)
    f0 = centre[np.arange(600) % 5] ^ (U(1) << rng.integers(0, 63, 600).astype(U))
    f1 = centre[np.arange(600) % 5]
    assert (simhash.forest(f0, f1, np.array([0, 600]), 4) == np.arange(600) % 5).all()


def test_rows_with_nulls_repeats_and_clashing_names(spark):
    schema = "doc_id long, text string, row string, k1 string, n long, keep string, f0 int"
    data = [(1, "one two three four five", "r", "k", 5, "x", 1)] * 3 + [(2, "one two three four five", "r", "k", 5, "x", 1), (None, None, "r", "k", 5, "x", 1), (3, None, "r", "k", 5, "x", 1), (3, None, "r", "k", 5, "x", 1), (None, "other words entirely here now", "r", "k", 5, "x", 1)]
    docs = spark.createDataFrame(data, schema)
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or -1, r["text"] or "") for r in kept.collect()) == [(-1, ""), (-1, "other words entirely here now"), (1, "one two three four five"), (3, ""), (3, "")]
    assert simhash.near_duplicates(docs.where("false")).count() == 0 and simhash.drop_near_duplicates(docs.where("false")).count() == 0


def test_long_texts_in_pieces(monkeypatch):
    from quire.llm import common

    texts = pa.array(["lorem ipsum dolor sit amet " * 400 + "end", "x" * 5000, "", None, "Ärger ÉTÉ été", "aé漢" * 3000 + " tail", "one " + "z" * 64 * 3, "z" * 64, "y" * 64 + " " + "w" * 128])
    whole = simhash.fingerprints(texts, 4)
    monkeypatch.setattr(common, "PIECE", 64)
    parts = simhash.fingerprints(texts, 4)
    assert all((a == b).all() for a, b in zip(whole, parts))


def test_split_keys_find_the_same_groups(spark):
    shared = "this passage stands in every one of them and is long enough to give keys in common"
    rng = random.Random(8)
    texts = [f"{shared} {' '.join(word(rng) for _ in range(3))}" for _ in range(80)] + corpus()[:40]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    whole = {r["doc_id"]: r["group_id"] for r in simhash.near_groups(docs).collect()}
    split = {r["doc_id"]: r["group_id"] for r in simhash.near_groups(docs, most=7).collect()}
    assert whole == split


def test_ids_of_text_and_ties(spark):
    docs = spark.createDataFrame([("b", "one two three four five six"), ("a", "one two three four five six"), ("a", "one two three four five six"), (None, "one two three four five six")], "doc_id string, text string")
    rows = simhash.near_duplicates(docs).collect()
    assert {r["group_id"] for r in rows} == {"a"} and [r["doc_id"] for r in rows if r["keep"]] == ["a"]
    assert [r["doc_id"] for r in simhash.drop_near_duplicates(docs).collect()] == ["a"]


def test_short_and_edited_copies_are_found(spark):
    rng = random.Random(11)
    texts, pairs = [], []
    for n, edits in [(15, 1), (30, 3), (60, 6), (200, 10)] * 60:
        base = [word(rng) for _ in range(n)]
        copy = list(base)
        for i in rng.sample(range(n), edits):
            copy[i] = word(rng)
        pairs.append((len(texts), len(texts) + 1))
        texts += [" ".join(base), " ".join(copy)]
    lo, hi, _, _ = simhash.fingerprints(pa.array(texts), 12)
    b = bits(lo, hi)
    near = [(i, j) for i, j in pairs if (b[i] != b[j]).sum() <= 26]
    got = {r["doc_id"]: r["group_id"] for r in simhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert len(near) > 100 and sum(got[i] == got[j] for i, j in near) >= 0.9 * len(near)


def test_components(spark):
    edges = [(i, i + 1) for i in range(20)] + [(50, 40), (40, 60), (7, 7), (99, 98)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 21)}, 50: 40, 60: 40, 99: 98}
