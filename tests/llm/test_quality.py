import random

import numpy as np
import pytest

from quire.llm import common, quality


def make(n, seed):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 8))) for _ in range(300)]
    docs, labels = [], []
    for i in range(n):
        text = " ".join(rng.choices(words, k=rng.randint(20, 400)))
        if i % 3 == 0:  # a bad passage within an otherwise good text
            text += " " + " ".join(w.upper() + "!!" for w in rng.choices(words, k=80))
        docs.append((seed * 1000 + i, text, "s"))
        labels.append((seed * 1000 + i, int(i % 3 > 0), 0))
    return docs, labels


@pytest.fixture(scope="module")
def model(spark):
    docs, labels = make(400, 1)
    return quality.fit(spark.createDataFrame(docs, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))


def test_held_out_accuracy(spark, model):
    docs, labels = make(150, 2)
    got = {r["doc_id"]: r["keep"] for r in quality.quality(spark.createDataFrame(docs, "doc_id long, text string, score string"), None, model).collect()}
    assert np.mean([got[d] == bool(q) for d, q, _ in labels]) >= 0.95


def test_rows(spark, model):
    data = [(1, None), (2, ""), (3, " \n\t"), (None, "abc def"), (5, "abc def"), (5, "abc def"), (6, "abc " * 200000)]
    rows = quality.quality(spark.createDataFrame([(*d, "x", True) for d in data], "doc_id long, text string, score string, keep boolean"), None, model).collect()
    assert len(rows) == 7
    for r in rows:
        if r["doc_id"] in (1, 2, 3):
            assert r["score"] is None and r["keep"] is False and r["passages"] == 0
        else:
            assert 0 <= r["score"] <= 1 and r["passages"] == (3125 if r["doc_id"] == 6 else 1)
    assert quality.quality(spark.createDataFrame([], "doc_id long, text string"), None, model).count() == 0


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    for labels in ([], [(1, 1)], [(1, None), (None, 0)], [(8, 0), (9, 1)]):
        out = quality.quality(docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect()
        assert [(r["score"], r["keep"]) for r in out] == [(None, True)] * 2


def test_pieces_make_no_difference(monkeypatch):
    flat = np.frombuffer(("abc déf, GHI! 12\n" * 300).encode(), np.uint8)
    offs = np.array([0, 500, 500, len(flat)])
    whole = quality.encode(flat, offs)
    monkeypatch.setattr(quality, "WINDOW", 61)
    monkeypatch.setattr(common, "PIECE", 83)
    parts = quality.encode(flat, offs)
    assert np.allclose(whole[0], parts[0], atol=1e-5) and (whole[1] == parts[1]).all()


def test_forward_pass_equals_a_slow_one(model):
    import math

    import pyarrow as pa

    w = [np.asarray(x) for x in model.weights]
    flat = np.frombuffer("".join(t for _, t, _ in make(3, 4)[0]).encode(), np.uint8)
    x, _ = quality.encode(flat, np.array([0, len(flat)]))
    z = np.clip((x - model.mean) / model.scale, -8, 8)
    hidden = [[math.tanh(sum(z[i][k] * w[0][k][j] for k in range(quality.DIM)) + w[1][j]) for j in range(w[0].shape[1])] for i in range(len(z))]
    e = []
    for h in hidden:
        gate = [math.tanh(sum(h[k] * w[2][k][j] for k in range(len(h)))) / (1 + math.exp(-sum(h[k] * w[3][k][j] for k in range(len(h))))) for j in range(w[2].shape[1])]
        e.append(math.exp(sum(g * a for g, a in zip(gate, w[4]))))
    weights = [v / sum(e) for v in e]
    mean = [sum(a * h[k] for a, h in zip(weights, hidden)) for k in range(len(hidden[0]))]
    score = 1 / (1 + math.exp(-(sum(m * o for m, o in zip(mean, w[5])) + w[6][0])))
    text = flat.tobytes().decode()
    logit = quality._forward(z.astype(np.float64), np.array([0]), model.weights)[-1][0]
    assert abs(1 / (1 + math.exp(-logit)) - score) < 1e-9 and len(hidden) == len(quality.encode(np.frombuffer(text.encode(), np.uint8), np.array([0, len(flat)]))[0])
    assert pa.array([text]) is not None


def test_clashing_names_and_repeated_labels(spark):
    docs, labels = make(120, 3)
    named = spark.createDataFrame([(d, t, 1, 0, "x") for d, t, _ in docs], "doc_id long, text string, quality int, toxic int, x string")
    twice = spark.createDataFrame([(*r, "t") for r in labels] + [(r[0], None, None, "t") for r in labels], "doc_id long, quality int, toxic int, text string")
    out = quality.quality(named, twice)
    assert out.columns == ["doc_id", "score", "passages", "attention", "keep"] and out.count() == 120
    good = {d for d, q, _ in labels if q}
    assert np.mean([r["keep"] == (r["doc_id"] in good) for r in out.collect()]) > 0.9
