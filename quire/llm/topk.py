"""Operator 10, exact top-k search over a pivot-distance index (iDistance, Jagadish et al., 2005).

Each vector is keyed by its nearest pivot and its distance from it; the vectors of a pivot, sorted by distance, are cut into annuli
of at most ``cell`` members, each a file in the shared folder. By the triangle inequality a vector x of pivot p can be within radius r
of q only if |d(q, p) - d(x, p)| <= r. A query therefore visits annuli from the nearest on, leaves out those whose span of distances
doesn't come within the radius of its k best so far, and in the others looks at the members within only. Results are exact.

Queries are the rows whose id is divisible by ``every``, against all rows. A task takes a block of up to ``BLOCK`` queries that lie
close by (pivot, distance) and holds their best k while the annuli pass by, so that no candidate is shuffled; a first pass in float32 with a bound
of its rounding finds the pairs that may be near enough, which are then compared in float64.

Scale: the index (file, pivot, least and greatest distance of each annulus) has a row for ``cell`` vectors and is sent to the
tasks. A vector is shuffled twice, to drop repeated ids and to its annulus. Memory holds an annulus and a block. A block reads each annulus that its
bounds don't exclude. Where distances concentrate, as for random vectors in many dimensions, the bounds exclude little and the work is that of
comparing all queries with all rows, whatever the index.

Cases: see quire.llm.vectors. A query has fewer than k results only where there are fewer other ids.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import drop_dir, materialize, new_dir
from quire.llm.vectors import DIGITS, matrix, nearest, packed, sound, unpacked, usable
from quire.llm.warc import _open

EVERY = 50
"""Queries of op10_exact_topk and op3_cross_polytope are the rows whose id is divisible by it."""
SLACK = 4e-6
"""Room for rounding: rows whose rounded distances tie must all be compared."""
BLOCK, TILE = 4096, 1024


def distances(x: np.ndarray, pivot: np.ndarray) -> np.ndarray:
    """(rows, pivots), from differences, so that they are exact to a relative 1e-15 wherever the vectors lie."""
    return np.stack([np.sqrt(((x - p) ** 2).sum(1)) for p in pivot], 1) if len(x) else np.zeros((0, len(pivot)))


class Best:
    """The best k of a block of queries among all members that were shown to it."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int, centre: np.ndarray, scale: float) -> None:
        self.qi, self.q, self.k, self.centre, self.scale = ids, x, k, centre, scale
        near = (x - centre) * scale
        self.norm = np.sqrt((near * near).sum(1))
        self.left = np.concatenate([near, np.full((len(x), 1), -1)], 1).astype(np.float32)
        self.ids, self.d = np.full((len(x), k), np.iinfo(np.int64).max), np.full((len(x), k), np.inf)
        self.space = np.zeros(0, np.float32)  # of the products, made once

    @property
    def radius(self) -> np.ndarray:
        return self.d[:, -1]

    def show(self, rows: np.ndarray, mi: np.ndarray, m: np.ndarray) -> None:
        """Members that may be among the best of the queries ``rows``."""
        wide = max(TILE, min(1 << 14, TILE * TILE // max(1, len(rows))))
        for b in range(0, len(mi), wide):
            z = m[b : b + wide].astype(np.float64)
            near = (z - self.centre) * self.scale
            half = (near * near).sum(1) / 2
            right = np.concatenate([near, half[:, None]], 1).astype(np.float32).T
            most = float(np.sqrt(2 * half.max()))
            for a in range(0, len(rows), TILE):
                self._tile(rows[a : a + TILE], mi[b : b + wide], z, right, most)

    def _tile(self, rows: np.ndarray, mi: np.ndarray, z: np.ndarray, right: np.ndarray, most: float) -> None:
        # |q - m| <= r where q.m - |m|^2 / 2 >= (|q|^2 - r^2) / 2; ``room`` is twice the greatest rounding of the left side in float32
        norm, r = self.norm[rows], self.radius[rows]
        room = (z.shape[1] + 8) * 2.0**-23 * (norm * most + most * most / 2 + norm * norm / 2) + 1e-30
        with np.errstate(over="ignore"):
            least = (norm**2 - ((r + SLACK + 1e-12 * r) * self.scale) ** 2) / 2 - room
        size = len(rows) * len(mi)
        if len(self.space) < size:
            self.space = np.zeros(size, np.float32)
        g = np.matmul(self.left[rows], right, out=self.space[:size].reshape(len(rows), len(mi)))
        if (open_ := np.flatnonzero(np.isinf(r))).size:  # fewer than k are known; the query itself may be among the members
            kk = min(self.k + 1, len(mi))
            kth = np.partition(g[open_], len(mi) - kk, axis=1)[:, len(mi) - kk].astype(np.float64)
            least[open_] = kth - 2 * room[open_] - np.maximum(kth_slack(self.scale, norm[open_], kth), 0) if kk == self.k + 1 else -np.inf
        some = np.flatnonzero(g.max(1) >= least)
        if not some.size:
            return
        i, j = np.nonzero(g[some] >= least[some, None])
        i = rows[some[i]]
        other = self.qi[i] != mi[j]
        i, j = i[other], j[other]
        d = np.concatenate([np.round(np.sqrt(((self.q[i[c : c + BLOCK]] - z[j[c : c + BLOCK]]) ** 2).sum(1)), DIGITS) for c in range(0, len(i), BLOCK)] or [np.zeros(0)])
        keep = (d < self.radius[i]) | ((d == self.radius[i]) & (mi[j] < self.ids[i, -1]))
        i, j, d = i[keep], j[keep], d[keep]
        if not len(i):
            return
        to, at = np.unique(i, return_inverse=True)
        ids, dist = np.concatenate([self.ids[to].ravel(), mi[j]]), np.concatenate([self.d[to].ravel(), d])
        best = nearest(ids, dist, np.concatenate([np.repeat(np.arange(len(to)), self.k), at]), self.k)
        self.ids[to], self.d[to] = ids[best].reshape(-1, self.k), dist[best].reshape(-1, self.k)


def kth_slack(scale: float, norm: np.ndarray, kth: np.ndarray) -> np.ndarray:
    """How much lower than the k-th greatest product one may be whose rounded distance ties with it."""
    r = np.sqrt(np.maximum(norm**2 - 2 * kth, 0))
    return r * SLACK * scale + (SLACK * scale) ** 2


def exact_topk(vectors: DataFrame, k: int = 10, pivots: int = 16, cell: int = 16384, seed: int = 3, every: int = 1) -> DataFrame:
    """vec_id, neighbor_id, rank (from 1) and distance (Euclidean) of the k nearest others of every row whose id is divisible by ``every``.

    The index is computed at once.
    """
    spark = vectors.sparkSession
    rows, n, dim = usable(vectors)
    if n < 2:
        return rows.select("vec_id", F.lit(0).cast("bigint").alias("neighbor_id"), F.lit(0).alias("rank"), F.lit(0.0).alias("distance")).where("false")
    # pivots: the vectors with the least hashes, thinned to those farthest apart; their number is fixed, and any points give exact results
    pool = sound(vectors).where(F.size("embedding") == dim).orderBy(F.xxhash64("vec_id", F.lit(seed)), "vec_id").limit(8 * pivots).toPandas()
    pool = np.array(pool["embedding"].tolist(), np.float64).reshape(-1, dim)
    chosen = [0]
    far = distances(pool, pool[:1])[:, 0]
    while len(chosen) < min(pivots, len(pool)):
        chosen.append(int(far.argmax()))
        far = np.minimum(far, distances(pool, pool[chosen[-1:]])[:, 0])
    pivot = pool[chosen]
    centre = pivot.mean(0)

    def key(batches):
        for b in batches:
            x = matrix(b.column("embedding"), dim)
            d = distances(x, pivot)
            p = d.argmin(1) if len(x) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column("vec_id").cast(pa.int64()), packed(x), pa.array(p.astype(np.int32)), pa.array(d[np.arange(len(x)), p])], ["vec_id", "v", "p", "d"])

    keyed, at = materialize(rows.mapInArrow(key, "vec_id bigint, v binary, p int, d double"), "topk")
    asked = materialize(keyed.where(F.col("vec_id") % every == 0), "topk-queries")[0] if every > 1 else keyed
    folder = new_dir(spark, "topk-annuli")

    def store(batches):
        """Annuli as files of ids, distances and vectors, named at random, so that a lost or repeated task does no harm."""
        sink, path = _open(folder)
        sink.create_dir(path)
        held, last = [], None

        def flush():
            t = pa.Table.from_batches(held)
            ids, d, v = np.asarray(t.column("vec_id")).astype(np.int64), np.asarray(t.column("d")), unpacked(t.column("v"), dim)
            name = uuid.uuid4().hex
            with sink.open_output_stream(f"{path}/{name}", compression=None) as out:
                for x in (ids, d, v.astype(np.float32)):
                    out.write(np.ascontiguousarray(x).tobytes())
            held.clear()
            far = float(np.sqrt(((v - centre) ** 2).sum(1)).max())
            return pa.RecordBatch.from_pydict({"name": [name], "n": [len(ids)], "p": [last], "lo": [d[0]], "hi": [d[-1]], "far": [far]}, INDEX)

        for b in batches:
            p = np.asarray(b.column("p"))
            a = 0
            while a < b.num_rows:
                if held and (p[a] != last or sum(h.num_rows for h in held) >= cell):
                    yield flush()
                last = int(p[a])
                z = min(a + int(np.searchsorted(p[a:], last, "right")), a + cell - sum(h.num_rows for h in held))
                held.append(b.slice(a, z - a))
                a = z
        if held:
            yield flush()

    index = keyed.repartitionByRange("p", "d").sortWithinPartitions("p", "d").mapInArrow(store, "name string, n bigint, p bigint, lo double, hi double, far double").collect()
    if every > 1:
        drop_dir(spark, at)
    scale = 1 / (max(max(r["far"] for r in index), 1e-7 * float(np.sqrt((centre**2).sum()))) or 1.0)

    def annulus(source, path: str, name: str, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        with source.open_input_stream(f"{path}/{name}", compression=None) as f:
            data = f.read()
        return np.frombuffer(data, np.int64, n), np.frombuffer(data, np.float64, n, 8 * n), np.frombuffer(data, np.float32, n * dim, 16 * n).reshape(n, dim)

    def block(source, path: str, ids: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
        best, d = Best(ids, x, k, centre, scale), distances(x, pivot)

        def bound(r) -> np.ndarray:
            return np.maximum(np.maximum(r["lo"] - d[:, r["p"]], d[:, r["p"]] - r["hi"]), 0)

        for _, _, r in sorted(((float((x := bound(r)).min()), float(x.mean()), r) for r in index), key=lambda y: y[:2]):
            radius, own = best.radius, d[:, r["p"]]
            slack = SLACK + 1e-12 * (own + np.where(np.isinf(radius), 0, radius))
            near = np.flatnonzero(bound(r) <= radius + slack)
            if near.size:
                mi, md, m = annulus(source, path, r["name"], r["n"])
                a = int(np.searchsorted(md, (own - radius - slack)[near].min(), "left"))
                z = int(np.searchsorted(md, (own + radius + slack)[near].max(), "right"))
                best.show(near, mi[a:z], m[a:z])
        found = np.isfinite(best.d)
        q, i = np.nonzero(found)
        return pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(best.ids[found]), pa.array((i + 1).astype(np.int32)), pa.array(best.d[found])], ["vec_id", "neighbor_id", "rank", "distance"])

    def search(batches):
        source, path = _open(folder)
        held = [b for b in batches if b.num_rows]
        if held:
            t = pa.Table.from_batches(held)
            order = np.lexsort((np.asarray(t.column("d")), np.asarray(t.column("p"))))
            ids, x = np.asarray(t.column("vec_id")).astype(np.int64)[order], unpacked(t.column("v"), dim)[order]
            for a in range(0, len(ids), BLOCK):
                yield block(source, path, ids[a : a + BLOCK], x[a : a + BLOCK])

    many = asked.count()
    blocks = max(1, -(-many // BLOCK), min(2 * spark.sparkContext.defaultParallelism, -(-many // 64)))
    return asked.repartitionByRange(blocks, "p", "d").mapInArrow(search, "vec_id bigint, neighbor_id bigint, rank int, distance double")


INDEX = pa.schema([("name", pa.string()), ("n", pa.int64()), ("p", pa.int64()), ("lo", pa.float64()), ("hi", pa.float64()), ("far", pa.float64())])


SQL = f"""WITH v AS (SELECT vec_id, min(embedding)::DOUBLE[] AS e FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0 GROUP BY vec_id),
pairs AS (SELECT a.vec_id, b.vec_id AS neighbor_id, round(list_distance(a.e, b.e), {DIGITS}) AS distance FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % {EVERY} = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, neighbor_id)::INTEGER AS rank FROM pairs)
SELECT vec_id, neighbor_id, rank, distance FROM ranked WHERE rank <= 10"""
