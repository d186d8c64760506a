"""Operator 9, quality by attention-based multiple-instance learning (gated attention of Ilse et al., 2018).

A document is a bag of passages of ``WORDS`` words. A passage is encoded by shares of character classes, word statistics
and the mean of random projections of its hashed byte trigrams, then by a tanh layer. A gated network gives each passage
an attention weight (a softmax over the document), the weighted mean of the encoded passages represents the document, and
a logistic layer scores it. Everything after the fixed features is learnt from document labels by Adam in numpy.

Cases: a null text, or one without a word, has no passage: score null, keep false, passages 0. Texts are encoded whole, in
pieces. Documents without a label are scored like others; of several labels of a document the least counts; rows without
doc_id take no part in training. Without labels of both kinds nothing can be learnt: scores are null and all are kept.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import doc_words, runs, segments, student, text_buffers

WORDS, PROJECT, BUCKETS, WINDOW = 64, 16, 1 << 14, 1 << 16
SPACE = np.arange(256, dtype=np.uint8)
SPACE[[9, 10, 11, 12, 13, 32]] = 32
CLASSES = np.zeros(256, np.uint8)
for _k, _s in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n\r", b".,;:'\"()-", b"!?", b"#$%&*|@<>{}[]\\/^~`=+_"), 1):
    CLASSES[list(_s)] = _k
N_CLASSES = 9
DIM = N_CLASSES + 4 + PROJECT
TABLE = np.random.default_rng(11).choice(np.array([-1, 1], np.float32), (BUCKETS, PROJECT))


def spaces(flat: np.ndarray) -> np.ndarray:
    return SPACE[flat]


def encode(flat: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features (passages, DIM) and the document of every passage."""
    h, doc, start = doc_words(flat, offs, spaces)
    if not len(h):
        return np.zeros((0, DIM), np.float32), np.zeros(0, np.int64)
    first = segments(doc)
    nth = np.arange(len(h)) - np.repeat(first, np.diff(np.append(first, len(h))))
    begin = np.flatnonzero(nth % WORDS == 0)
    n, p_doc, at = len(begin), doc[begin], start[begin]
    stop = np.minimum(np.append(at[1:], len(flat)), offs[p_doc + 1])
    words = np.diff(np.append(begin, len(h))).astype(np.float64)
    passage = np.repeat(np.arange(n), words.astype(np.int64))
    key = np.sort(passage.astype(np.uint64) << np.uint64(40) | h >> np.uint64(24))
    distinct = np.bincount((key[np.concatenate(([True], key[1:] != key[:-1]))] >> np.uint64(40)).astype(np.int64), minlength=n)
    again = np.zeros(n)
    same = np.flatnonzero((h[1:] == h[:-1]) & (passage[1:] == passage[:-1])) + 1
    np.add.at(again, passage[same], 1)
    classes, project = np.zeros((n, N_CLASSES)), np.zeros((n, PROJECT))
    for a in range(int(at[0]), len(flat), WINDOW):
        z = min(len(flat), a + WINDOW)
        owner = np.maximum(np.searchsorted(at, np.arange(a, z), "right") - 1, 0)
        code = CLASSES[flat[a:z]]
        f = segments(owner)
        classes[owner[f]] += np.stack([np.add.reduceat(code == k, f, dtype=np.int64) for k in range(N_CLASSES)], 1)
        b = flat[a : z + 2].astype(np.uint32)
        m = len(b) - 2
        if m > 0:
            tri = (b[:m] * np.uint32(0x01000193) + b[1 : m + 1]) * np.uint32(0x01000193) + b[2:]
            tri = (tri * np.uint32(0x9E3779B1)) >> np.uint32(18)
            f = segments(owner[:m])
            project[owner[f]] += np.add.reduceat(TABLE[tri], f, axis=0)
    size = np.maximum(stop - at, 1).astype(np.float64)
    x = np.concatenate([classes / size[:, None], np.stack([np.log(words), size / words / 8, distinct / words, again / words], 1), project / size[:, None] ** 0.5 / 4], 1)
    return x.astype(np.float32), p_doc


class Model(NamedTuple):
    mean: np.ndarray
    scale: np.ndarray
    weights: tuple[np.ndarray, ...]
    threshold: float


def _forward(x: np.ndarray, first: np.ndarray, w) -> tuple:
    enc, enc_b, v, u, a, out, out_b = w
    sizes = np.diff(np.append(first, len(x)))
    h = np.tanh(x @ enc + enc_b)
    t, g = np.tanh(h @ v), 1 / (1 + np.exp(-(h @ u)))
    e = (t * g) @ a
    e = np.exp(e - np.repeat(np.maximum.reduceat(e, first), sizes))
    alpha = e / np.repeat(np.add.reduceat(e, first), sizes)
    z = np.add.reduceat(alpha[:, None] * h, first, axis=0)
    return sizes, h, t, g, alpha, z, z @ out + out_b


def fit(docs: DataFrame, labels: DataFrame, rows_per_class: int = 1000, hidden: int = 24, gate: int = 12, epochs: int = 30, rate: float = 0.01, batch: int = 64, keep_clean: float = 0.999, seed: int = 5) -> Model | None:
    """Train on about ``rows_per_class`` labelled documents of each class, chosen by hash: the bound on what is collected.

    A fifth is held out. The threshold keeps ``keep_clean`` of its good documents: it is the lesser of that quantile of their
    scores and Student's bound on a further document by the mean and deviation of their log-odds, as few documents say little of a small share.
    """
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min((F.col("quality") > 0).cast("int")).alias("quality"))
    per = {r["quality"]: r["n"] for r in known.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    if len(per) < 2:
        return None
    share = F.when(F.col("quality") == 1, int(min(1.0, rows_per_class / per[1]) * 2**20)).otherwise(int(min(1.0, rows_per_class / per[0]) * 2**20))
    some = known.where(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(2**20)) < share).limit(4 * rows_per_class)
    picked = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(some), "doc_id").limit(8 * rows_per_class).toPandas()  # bounded by rows_per_class
    picked = picked.sort_values(["doc_id", "text"], kind="stable")
    bags, y = [], []
    for text, q in zip(picked["text"], picked["quality"]):
        flat = np.frombuffer(text.encode(), np.uint8)
        x, _ = encode(flat, np.array([0, len(flat)]))
        if len(x):
            bags.append(x)
            y.append(q)
    if len(set(y)) < 2:
        return None
    y, rng = np.array(y, np.float64), np.random.default_rng(seed)
    held = np.arange(len(y)) % 5 == 4
    train, test = np.flatnonzero(~held), np.flatnonzero(held) if held.any() else np.flatnonzero(~held)
    every = np.concatenate([bags[i] for i in train])
    mean, scale = every.mean(0), every.std(0) + 1e-3
    bags = [np.clip((b - mean) / scale, -8, 8).astype(np.float64) for b in bags]
    w = [rng.normal(0, DIM**-0.5, (DIM, hidden)), np.zeros(hidden), *(rng.normal(0, hidden**-0.5, (hidden, gate)) for _ in range(2)), rng.normal(0, gate**-0.5, gate), rng.normal(0, hidden**-0.5, hidden), np.zeros(1)]
    m1, m2, step = [np.zeros_like(x) for x in w], [np.zeros_like(x) for x in w], 0
    part = {k: (y[train] == k).mean() for k in (0, 1)}
    weight = np.array([0.5 / max(part[int(v)], 1e-3) for v in y])
    for _ in range(epochs):
        order = rng.permutation(train)
        for s in range(0, len(order), batch):
            some_ = order[s : s + batch]
            x = np.concatenate([bags[i] for i in some_])
            first = np.concatenate(([0], np.cumsum([len(bags[i]) for i in some_])[:-1]))
            sizes, h, t, g, alpha, z, logit = _forward(x, first, w)
            d = (1 / (1 + np.exp(-logit)) - y[some_]) * weight[some_] / len(some_)
            dz = np.repeat(d[:, None] * w[5], sizes, axis=0)
            da = (dz * h).sum(1)
            de = alpha * (da - np.repeat(np.add.reduceat(alpha * da, first), sizes))
            dg_t = de[:, None] * w[4]
            dt, dg = dg_t * g * (1 - t * t), dg_t * t * g * (1 - g)
            dh = (alpha[:, None] * dz + dt @ w[2].T + dg @ w[3].T) * (1 - h * h)
            grad = [x.T @ dh, dh.sum(0), h.T @ dt, h.T @ dg, (t * g).T @ de, z.T @ d, np.array([d.sum()])]
            step += 1
            for k, gk in enumerate(grad):
                gk = gk + 1e-4 * w[k]
                m1[k] = 0.9 * m1[k] + 0.1 * gk
                m2[k] = 0.999 * m2[k] + 0.001 * gk * gk
                w[k] = w[k] - rate * (1 - step / (epochs * (len(order) // batch + 1) + 1)) * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)
    p = np.array([1 / (1 + np.exp(-_forward(bags[i], np.array([0]), w)[-1][0])) for i in test])
    good = np.clip(p[y[test] == 1], 1e-12, 1 - 1e-12)
    threshold = 0.5
    if len(good):
        odds = np.log(good / (1 - good))
        low = min(np.quantile(odds, 1 - keep_clean, method="lower"), odds.mean() + student(1 - keep_clean, len(odds) - 1) * odds.std() * (1 + 1 / len(odds)))
        threshold = float(1 / (1 + np.exp(-low)))
    return Model(mean, scale, tuple(w), threshold)


def scorer(model: Model):
    """Column function: text to struct<score, passages, attention>; attention is the largest weight of a passage."""

    @F.arrow_udf("struct<score: double, passages: int, attention: double>")
    def mil_score(text: pa.Array) -> pa.Array:
        flat, offs, _ = text_buffers(text)
        n = len(offs) - 1
        score, count, top = np.zeros(n), np.zeros(n, np.int32), np.zeros(n)
        for a, b in runs(offs, 1 << 19):
            x, doc = encode(flat[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
            if len(x):
                first = segments(doc)
                sizes, _, _, _, alpha, _, logit = _forward(np.clip((x - model.mean) / model.scale, -8, 8).astype(np.float64), first, model.weights)
                at = a + doc[first]
                score[at], count[at], top[at] = 1 / (1 + np.exp(-logit)), sizes, np.maximum.reduceat(alpha, first)
        none = count == 0
        return pa.StructArray.from_arrays([pa.array(score, mask=none), pa.array(count), pa.array(top, mask=none)], ["score", "passages", "attention"])

    return mil_score.asNondeterministic()


def quality(docs: DataFrame, labels: DataFrame, model: Model | None = None, **params) -> DataFrame:
    """doc_id, score, passages, attention and keep of every row of docs; ``params`` are those of fit()."""
    model = model or fit(docs, labels, **params)
    if model is None:
        none = F.lit(None).cast("double")
        return docs.select("doc_id", none.alias("score"), F.lit(None).cast("int").alias("passages"), none.alias("attention"), F.lit(True).alias("keep"))
    scored = docs.select("doc_id", scorer(model)("text").alias("x"))
    return scored.select("doc_id", "x.score", "x.passages", "x.attention", F.coalesce(F.col("x.score") >= F.lit(model.threshold), F.lit(False)).alias("keep"))
