"""Operator 2, language identification: averaged hashed subword embeddings, a linear softmax, calibrated rejection.

Subwords are 3- and 4-grams of the lower-cased UTF-8 bytes of a word with a boundary on either side. Each falls by its
hash into one of ``buckets`` rows of an embedding table (one table an order), a document is the mean of its rows, and a
linear softmax over that mean gives the language. Both layers are trained by stochastic gradient descent in numpy on a
bounded sample of labelled rows. The mean and the softmax's linear map commute, so that scoring looks up embedding times
weights, a row of one float a language: the same function as the trained one, at a fraction of the price.

Rejection: on held-out labelled rows a temperature is fitted to the logits by their likelihood, with labels smoothed by
one row in all, so that it stays finite where no row is wrong. The threshold of the calibrated confidence is the
``false_reject`` quantile of the rows identified rightly: the lesser of that of the rows and Student's bound on a
further row by the mean and deviation of their log-odds, as the rows alone are too few for small shares. A text is also rejected if
the share of its subwords that training rows have is under ``least_known`` of what that quantile of held-out rows has: it
is in no trained language. A text without any subword has no evidence and is rejected.

Cases: a null or empty text, or one without letters, is rejected with null language and confidence 0; whole texts are
read in pieces, so that length doesn't matter; ties go to the language that sorts first; repeated rows get the same
answer; if no row has both text and language, nothing can be learnt and every row is rejected.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import PIECE, fold_bytes, student, text_buffers

ORDERS = (3, 4)
SCHEMA = "struct<lang: string, confidence: double, keep: boolean>"


class Model(NamedTuple):
    labels: tuple[str, ...]
    scores: np.ndarray  # (orders * buckets, labels) float32: embedding times weights
    bias: np.ndarray
    temperature: float
    threshold: float
    known: np.ndarray  # (orders * buckets) bool: rows that a training text has
    least: float  # share of known subwords


def subwords(flat: np.ndarray, ends: np.ndarray, at: int, to: int, buckets: int):
    """For each order the positions in [at, to) where a subword starts and its row of the table.

    ``ends``: of each document its end in flat; a subword lies within one document.
    """
    piece = fold_bytes(flat[at : to + ORDERS[-1] - 1])
    n = to - at
    doc_end = ends[np.searchsorted(ends, np.arange(at, to), "right")] - at
    letter = piece != 32
    for k, order in enumerate(ORDERS):
        m = max(0, min(n, len(piece) - order + 1))
        ok = doc_end[:m] >= np.arange(m) + order
        h = np.zeros(m, np.uint32)
        for i in range(order):
            h = h * np.uint32(0x01000193) + piece[i : i + m]
            if 0 < i < order - 1:
                ok &= letter[i : i + m]
        pos = np.flatnonzero(ok)
        h = h[pos] * np.uint32(0x9E3779B1)
        yield pos + at, ((h ^ (h >> np.uint32(15))) % np.uint32(buckets)).astype(np.int32) + np.int32(k * buckets)


def _features(texts: list[str], buckets: int) -> list[tuple[np.ndarray, np.ndarray]]:
    out = []
    for t in texts:
        flat = np.frombuffer(t.encode(), np.uint8)
        rows = [r for a in range(0, len(flat), PIECE) for _, r in subwords(flat, np.array([len(flat)]), a, min(len(flat), a + PIECE), buckets)]
        u, n = np.unique(np.concatenate(rows), return_counts=True) if rows else (np.zeros(0, np.int32), np.zeros(0, int))
        out.append((u, (n / max(1, n.sum())).astype(np.float32)))
    return out


def fit(docs: DataFrame, rows_per_lang: int = 400, buckets: int = 1 << 16, dim: int = 16, epochs: int = 6, rate: float = 2.0, false_reject: float = 0.001, least_known: float = 0.5, seed: int = 7) -> Model:
    """Train on about ``rows_per_lang`` rows of each value of ``lang``, chosen by hash: the bound on what the driver reads.

    A fifth of them is held out for calibration. doc_id, text and lang are read.
    """
    known = docs.select("doc_id", "text", "lang").where("text is not null and lang is not null and length(text) > 0")
    per = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not per:
        return Model((), np.zeros((len(ORDERS) * buckets, 0), np.float32), np.zeros(0, np.float32), 1.0, 1.0, np.zeros(len(ORDERS) * buckets, bool), 0.0)
    share = F.create_map(*[F.lit(x) for k, n in sorted(per.items()) for x in (k, int(min(1.0, rows_per_lang / n) * 2**20))])
    picked = known.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(2**20)) < share[F.col("lang")]).limit(3 * rows_per_lang * len(per)).toPandas()
    picked = picked.sort_values(["lang", "doc_id", "text"], kind="stable")
    labels = tuple(sorted(per))
    y = np.array([labels.index(x) for x in picked["lang"]], int)
    x = _features(picked["text"].tolist(), buckets)
    rng = np.random.default_rng(seed)
    held = np.arange(len(y)) % 5 == 4
    train, test = np.flatnonzero(~held), np.flatnonzero(held) if held.any() else np.flatnonzero(~held)
    size = len(ORDERS) * buckets
    e, w, b, seen = rng.uniform(-1 / dim, 1 / dim, (size, dim)).astype(np.float32), np.zeros((len(labels), dim), np.float32), np.zeros(len(labels), np.float32), np.zeros(size, bool)
    steps, step = epochs * len(train), 0
    for _ in range(epochs):
        for i in rng.permutation(train):
            u, c = x[i]
            lr, step = rate * (1 - step / steps), step + 1
            if not len(u):
                continue
            z = c @ e[u]
            p = w @ z + b
            p = np.exp(p - p.max())
            p /= p.sum()
            p[y[i]] -= 1
            back = p @ w
            w -= lr * np.outer(p, z)
            b -= lr * 0.1 * p
            e[u] -= lr * c[:, None] * len(u) ** 0.5 * back
            seen[u] = True
    e[~seen] = 0  # a subword that no training row has says nothing
    scores = e @ w.T
    logits = np.array([c @ scores[u] + b for u, c in (x[i] for i in test)], np.float64).reshape(len(test), len(labels))

    def softmax(t: float) -> np.ndarray:
        p = np.exp((logits - logits.max(1, keepdims=True)) / t)
        return p / p.sum(1, keepdims=True)

    truth = np.eye(len(labels))[y[test]] * (1 - 1 / (len(test) + 1)) + 1 / (len(test) + 1) / len(labels)
    temperature = min(np.geomspace(0.01, 100, 161), key=lambda t: -(truth * np.log(np.maximum(softmax(t), 1e-300))).sum(1).mean()) if len(test) else 1.0
    p = softmax(temperature)
    right = p.argmax(1) == y[test]
    sure, share = np.minimum(p.max(1)[right], 1 - 1e-12), np.array([c @ seen[u] for u, c in (x[i] for i in test)])[right]
    threshold = least = 0.0
    if right.any():
        odds = np.log(sure / np.maximum(1 - sure, 1e-12)) if len(labels) > 1 else np.zeros(len(sure))
        low = min(np.quantile(odds, false_reject, method="lower"), odds.mean() + student(false_reject, len(odds) - 1) * odds.std() * (1 + 1 / len(odds)))
        threshold, least = float(1 / (1 + np.exp(-low))), least_known * float(np.quantile(share, false_reject, method="lower"))
    return Model(labels, scores.astype(np.float32), b, float(temperature), threshold, seen, least)


def predict(model: Model, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index of the language (-1: no evidence), the calibrated confidence and the share of known subwords of each text."""
    flat, offs, _ = text_buffers(column)
    n, ends = len(offs) - 1, offs[1:]
    total, count, known = np.zeros((n, len(model.labels))), np.zeros(n, np.int64), np.zeros(n, np.int64)
    for a in range(0, len(flat) if len(model.labels) else 0, PIECE):
        for pos, rows in subwords(flat, ends, a, min(len(flat), a + PIECE), len(model.scores) // len(ORDERS)):
            if not len(pos):
                continue
            doc = np.searchsorted(ends, pos, "right")
            first = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
            total[doc[first]] += np.add.reduceat(model.scores[rows], first, axis=0)
            known[doc[first]] += np.add.reduceat(model.known[rows], first, dtype=np.int64)
            count[doc[first]] += np.diff(np.append(first, len(doc)))
    if not len(model.labels):
        return np.full(n, -1), np.zeros(n), np.zeros(n)
    logits = (total / np.maximum(count, 1)[:, None] + model.bias) / model.temperature
    p = np.exp(logits - logits.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    return np.where(count > 0, p.argmax(1), -1), np.where(count > 0, p.max(1), 0.0), known / np.maximum(count, 1)


def identify(model: Model):
    """Column function: text to struct<lang, confidence, keep>."""
    names = np.array([*model.labels, None], object)

    @F.arrow_udf(SCHEMA)
    def langid(text: pa.Array) -> pa.Array:
        best, sure, known = predict(model, text)
        return pa.StructArray.from_arrays([pa.array(names[best], pa.string()), pa.array(sure), pa.array((best >= 0) & (sure >= model.threshold) & (known >= model.least))], ["lang", "confidence", "keep"])

    return langid.asNondeterministic()  # else a filter on the result makes Catalyst evaluate it twice


def language_id(docs: DataFrame, model: Model | None = None, **params) -> DataFrame:
    """doc_id, lang, confidence and keep of every row of docs; ``params`` are those of fit()."""
    model = model or fit(docs, **params)
    return docs.select("doc_id", identify(model)("text").alias("x")).select("doc_id", "x.lang", "x.confidence", "x.keep")


def keep_identified(docs: DataFrame, **params) -> DataFrame:
    """The rows of docs whose language is identified, with the columns of docs; lang becomes the language found."""
    rows = docs.select(F.struct("*").alias("row"), identify(fit(docs, **params))("text").alias("id")).where("id.keep")
    return rows.select(*[(F.col("id.lang") if c == "lang" else F.col("row").getField(c)).alias(c) for c in docs.columns])
