"""Operator 3, approximate nearest neighbours by cross-polytope hashing (Andoni et al., 2015).

Vectors are scaled to length 1. A table turns them by three rounds of random signs and a fast Hadamard transform and assigns
each to the nearest of all signed axes: its bucket. With two hashes a table, a bucket is a pair of axes. A query looks into the
``probes`` nearest buckets of each of ``tables`` tables; all vectors found there are compared by their exact distance, and the
best k of all tables are its result.

Number of hashes and probes: unless given, they are fitted to a bounded sample, two lots of ``sample`` queries; every row is in the index.
The k nearest of these queries are found by comparing them with every vector, in one pass. For one and two hashes the fewest probes are taken by which ``recall``
of those neighbours are met in each lot, so that neither is judged by the other's fit, and LEAST of them by the lower end of the mean's range of error (two standard
errors, none where all queries are in the sample); of both the cheaper is used. The sample is drawn from the queries, which may be unlike other rows. So recall is alike at every size and for every distribution; the work depends on the vectors, as it must:
close neighbours need one or two probes of fine buckets, those of random vectors in many dimensions a large share of all.

Queries are the rows whose id is divisible by ``every``, against all rows. A bucket's members come before the queries that probe it, which pass by in batches; distances are one matrix
product, and only the best k of a query leave a bucket. A vector is shuffled once for each bucket that it is in or probes, so that shuffle
is in proportion to the vectors. Memory holds the members of one bucket.

Cases: see quire.llm.vectors; vectors of length 0 take no part either. A query has fewer than k results where its buckets
have fewer members; rows of an empty table or a single one have none. Vectors at equal distance are ranked by id.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import materialize
from quire.llm.vectors import DIGITS, FOUND, lists, matrix, merge, nearest, packed, streamed, unpacked, usable


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows, scaled to keep lengths; the width is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], 2).reshape(n, d)
        h *= 2
    return x / d**0.5


def rotate(x: np.ndarray, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    for _ in range(3):
        x = hadamard(x * rng.choice([-1.0, 1.0], x.shape[1]))
    return x


def _axes(x: np.ndarray, seed: int) -> np.ndarray:
    """How far every signed axis is from each row, less its nearest one: (rows, 2 * width)."""
    r = rotate(x, seed)
    both = np.concatenate([r, -r], 1)
    return both.max(1, keepdims=True) - both


def buckets(x: np.ndarray, table: int, hashes: int, probes: int) -> np.ndarray:
    """(rows, probes) buckets of a table by nearness; the first is the row's own."""
    side = 2 * x.shape[1]
    few = min(probes, side)
    loss = [_axes(x, table * hashes + j + 1) for j in range(hashes)]
    if few == 1:
        return sum(a.argmin(1).astype(np.int64) * side**j for j, a in enumerate(loss))[:, None]
    top = [np.argsort(a, axis=1, kind="stable")[:, :few] for a in loss]
    if hashes == 1:
        return top[0].astype(np.int64)
    # the nearest probes of all combinations are among those whose ranks multiply to at most probes
    combos = [c for c in product(range(few), repeat=hashes) if np.prod([r + 1 for r in c]) <= probes]
    total = np.stack([sum(np.take_along_axis(loss[j], top[j][:, c[j], None], 1)[:, 0] for j in range(hashes)) for c in combos], 1)
    code = np.stack([sum(top[j][:, c[j]].astype(np.int64) * side**j for j in range(hashes)) for c in combos], 1)
    return np.take_along_axis(code, np.argsort(total, axis=1, kind="stable")[:, :probes], 1)


def _ranks(q: np.ndarray, m: np.ndarray, tables: int, hashes: int) -> np.ndarray:
    """For each pair of a query and its neighbour, the least rank of the neighbour's bucket in a table."""
    out = np.full(len(q), np.inf)
    for t in range(tables):
        losses = [(_axes(q, t * hashes + j + 1), _axes(m, t * hashes + j + 1).argmin(1)) for j in range(hashes)]
        at = sum(a[np.arange(len(q)), i] for a, i in losses)
        every = losses[0][0] if hashes == 1 else None
        if hashes == 1:
            rank = (every < at[:, None]).sum(1)
        else:
            a, b = np.sort(losses[0][0], 1), np.sort(losses[1][0], 1)
            rank = np.array([np.searchsorted(y, v - x, "left").sum() for x, y, v in zip(a, b, at)])
        out = np.minimum(out, rank)
    return out


LEAST = 0.9
"""Recall that the sample must make sure of."""


def fewest(q: np.ndarray, rank: np.ndarray, many: int, recall: float, sample: int) -> int:
    """Probes by which neighbours at these ranks are met; the queries q from ``sample`` on are the second lot, and there are ``many`` in all."""
    lots = [x for x in (rank[q < sample], rank[q >= sample]) if len(x)]
    probes = max(int(np.sort(x)[min(len(x) - 1, int(np.ceil(recall * len(x))) - 1)]) + 1 for x in lots)
    _, q, size = np.unique(q, return_inverse=True, return_counts=True)
    for more in np.unique(np.append(rank[rank >= probes] + 1, probes)):
        met = np.bincount(q, rank < more) / size
        error = met.std(ddof=1) / len(met) ** 0.5 if 1 < len(met) < many else 0
        if met.mean() - 2 * error >= LEAST - 1e-9:
            return int(more)
    return int(rank.max()) + 1


def plan(units: DataFrame, n: int, dim: int, wide: int, k: int, tables: int, recall: float, sample: int, every: int = 1) -> tuple[int, int]:
    """Hashes and probes by which ``recall`` of the true neighbours of two lots of ``sample`` queries of units (vec_id, unit) are met."""
    asked = units.where(F.col("vec_id") % every == 0)
    many = asked.count()
    some = asked.orderBy(F.xxhash64("vec_id"), "vec_id").limit(2 * sample).collect()
    if not some:
        return 1, 1
    ids, x = np.array([r["vec_id"] for r in some], np.int64), np.frombuffer(b"".join(r["unit"] for r in some), np.float32).reshape(-1, dim).astype(np.float64)

    def closest(batches):
        best = None
        for b in batches:
            mi, m = np.asarray(b.column("vec_id")).astype(np.int64), unpacked(b.column("unit"), dim)
            dot = x @ m.T
            dot[ids[:, None] == mi[None, :]] = -np.inf
            kk = min(k, len(mi))
            if not kk:
                continue
            at = np.argpartition(-dot, kk - 1, axis=1)[:, :kk]
            new = (np.take_along_axis(dot, at, 1), m[at])
            best = new if best is None else tuple(np.concatenate(p, 1) for p in zip(best, new))
            top = np.argsort(-best[0], axis=1, kind="stable")[:, :k]
            best = np.take_along_axis(best[0], top, 1), np.take_along_axis(best[1], top[:, :, None], 1)
        if best is not None:
            q = np.repeat(np.arange(len(ids)), best[0].shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(best[0].ravel()), packed(best[1].reshape(-1, dim))], ["q", "dot", "unit"])

    found = units.mapInArrow(closest, "q bigint, dot double, unit binary").where(F.col("dot") > float("-inf"))
    found = found.withColumn("i", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("dot"), "unit"))).where(F.col("i") <= k).collect()  # 2 * sample * k rows
    if not found:
        return 1, 1
    of = np.array([r["q"] for r in found])
    q = _wide(x[of], wide)
    m = _wide(np.frombuffer(b"".join(r["unit"] for r in found), np.float32).reshape(-1, dim).astype(np.float64), wide)
    best = None
    for hashes in (1, 2):
        probes = fewest(of, _ranks(q, m, tables, hashes), many, recall, sample)
        cost = probes * (n / (2 * wide) ** hashes + SENT)
        if best is None or (cost < best[0] and probes <= 2 * wide):
            best = (cost, hashes, probes)
    return best[1:]


SENT = 400
"""Vectors that can be compared in the time of sending one to a bucket."""


def _sent(batch: pa.RecordBatch, t: int, bucket: np.ndarray, member: bool) -> pa.RecordBatch:
    n = len(bucket)
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, t, np.int32)), pa.array(bucket), pa.array(np.full(n, member)), batch.column("vec_id"), batch.column("unit")], ["t", "bucket", "member", "vec_id", "unit"])


def _wide(x: np.ndarray, wide: int) -> np.ndarray:
    return np.concatenate([x, np.zeros((len(x), wide - x.shape[1]))], 1)


def neighbours(vectors: DataFrame, k: int = 10, tables: int = 16, recall: float = 0.93, sample: int = 256, hashes: int | None = None, probes: int | None = None, every: int = 1) -> DataFrame:
    """vec_id, neighbor_id, rank (from 1) and distance (Euclidean, of the unit vectors) of the best k of every row whose id is divisible by ``every``."""
    rows, n, dim = usable(vectors)
    if not n:
        return rows.select("vec_id", F.lit(0).cast("bigint").alias("neighbor_id"), F.lit(0).alias("rank"), F.lit(0.0).alias("distance")).where("false")
    wide = 1 << max(1, (dim - 1).bit_length())

    def scale(batches):
        for batch in batches:
            ids, x = np.asarray(batch.column("vec_id")).astype(np.int64), matrix(batch.column("embedding"), dim)
            norm = np.sqrt((x * x).sum(1))
            ids, x, norm = ids[norm > 0], x[norm > 0], norm[norm > 0]
            yield pa.RecordBatch.from_arrays([pa.array(ids), packed(x / norm[:, None])], ["vec_id", "unit"])

    units, _ = materialize(rows.mapInArrow(scale, "vec_id bigint, unit binary"), "ann")
    if hashes is None or probes is None:
        hashes, probes = plan(units, n, dim, wide, k, tables, recall, sample, every)

    def spread(batches):
        for batch in batches:
            x = _wide(unpacked(batch.column("unit"), dim), wide)
            asks = np.flatnonzero(np.asarray(batch.column("vec_id")).astype(np.int64) % every == 0)
            query = batch.take(pa.array(asks))
            for t in range(tables):
                yield _sent(batch, t, buckets(x, t, hashes, 1)[:, 0], True)
                to = buckets(x[asks], t, hashes, probes)
                for p in range(every == 1, to.shape[1]):  # members that are all queries search their own bucket as such
                    yield _sent(query, t, to[:, p], False)

    def search(members: pa.Table, group: pa.Table) -> pa.RecordBatch:
        ids, x = np.asarray(group.column("vec_id")).astype(np.int64), unpacked(group.column("unit"), dim)
        mi, mx = np.asarray(members.column("vec_id")).astype(np.int64), unpacked(members.column("unit"), dim)
        got: list[tuple] = []
        step = max(1, (1 << 20) // len(mi))
        for a in range(0, len(ids), step):
            dot = x[a : a + step] @ mx.T
            dot[ids[a : a + step, None] == mi[None, :]] = -np.inf
            kk = min(k, len(mi))
            least = np.partition(dot, len(mi) - kk, axis=1)[:, len(mi) - kk] - 1e-5
            q, m = np.nonzero((dot >= least[:, None]) & (dot > -np.inf))
            d = np.round(np.sqrt(((x[a + q] - mx[m]) ** 2).sum(1)), DIGITS)
            best = nearest(mi[m], d, q, k)
            got.append((mi[m[best]], d[best], q[best] + a))
        cat = [np.concatenate([g[i] for g in got]) if got else np.zeros(0, kind) for i, kind in enumerate((np.int64, float, np.int64))]
        return pa.RecordBatch.from_arrays([pa.array(ids), *lists(*cat, len(ids))], ["vec_id", "ids", "ds"])

    sent = units.mapInArrow(spread, "t int, bucket bigint, member boolean, vec_id bigint, unit binary")
    return merge(streamed(sent, ["t", "bucket"], search, every == 1, f"vec_id bigint, {FOUND}"), k, "distance")
