import numpy as np
import pytest

from quire.llm import ann, topk

SCHEMA = "vec_id long, embedding array<float>, rank int, distance string"


def frame(spark, x, ids=None):
    return spark.createDataFrame([(int(i), [float(c) for c in v], 1, "x") for i, v in zip(ids if ids is not None else range(len(x)), x)], SCHEMA)


def brute(x, ids, k, unit):
    x = x.astype(np.float32).astype(np.float64)
    if unit:
        x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32).astype(np.float64)
    out = set()
    for i in range(len(x)):
        d = np.round(np.sqrt(((x[i] - x) ** 2).sum(1)), 6)
        best = sorted((d[j], int(ids[j])) for j in range(len(x)) if j != i)[:k]
        out |= {(int(ids[i]), j, r + 1, dist) for r, (dist, j) in enumerate(best)}
    return out


@pytest.mark.parametrize(("n", "k", "cell"), [(300, 7, 40), (5, 10, 4096), (2, 1, 1)])
def test_exact_equals_brute_force(spark, n, k, cell):
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, 6)).round(1)
    x[n // 2 :: 7] = x[0]  # ties
    ids = rng.permutation(10 * n)[:n]
    got = topk.exact_topk(frame(spark, x, ids), k=k, pivots=4, cell=cell)
    assert {tuple(r) for r in got.collect()} == brute(x, ids, k, False)


def test_clusters_let_annuli_be_skipped(spark):
    rng = np.random.default_rng(9)
    x = np.concatenate([rng.normal(c * 50, 1, size=(60, 5)) for c in range(4)])
    got = topk.exact_topk(frame(spark, x), k=5, pivots=4, cell=16)
    assert {tuple(r) for r in got.collect()} == brute(x, np.arange(len(x)), 5, False)


@pytest.mark.parametrize("kind", ["far", "huge", "same", "spheres"])
def test_exact_where_float32_is_not(spark, kind):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(260, 8))
    if kind == "far":
        x += 3000
    elif kind == "huge":
        x[5] = 1e30
    elif kind == "same":
        x[:] = x[0]
    else:  # distances from the nearest pivot tie
        x = np.round(x / np.linalg.norm(x, axis=1, keepdims=True) * 4) * 1000
    ids = np.arange(260) - 60
    want = {r for r in brute(x, ids, 5, False) if r[0] % 20 == 0}
    got = topk.exact_topk(frame(spark, x, ids), k=5, pivots=3, cell=50, every=20).collect()
    assert {tuple(r) for r in got} == want and len(got) == 13 * 5


@pytest.mark.parametrize("search", [topk.exact_topk, ann.neighbours])
def test_no_row_asks(spark, search):
    x = np.random.default_rng(5).normal(size=(40, 4))
    assert search(frame(spark, x, np.arange(1, 41)), every=50).count() == 0


def test_op10_asks_for_every_fiftieth_row(spark):
    import __spark_entry__ as entry

    got = entry.queries()["op10_exact_topk"](spark, "/root/testdata/sf0.001").collect()
    assert {r["vec_id"] for r in got} == set(range(0, 500, 50)) and len(got) == 100
    x = np.array([r["embedding"] for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").orderBy("vec_id").collect()])
    assert {tuple(r) for r in got} == {r for r in brute(x, np.arange(len(x)), 10, False) if r[0] % 50 == 0}


@pytest.mark.parametrize("search", [topk.exact_topk, ann.neighbours])
def test_unusable_and_repeated_rows(spark, search):
    nan = float("nan")
    rows = [(1, [1.0, 0.0], 1, "x"), (2, [0.9, 0.1], 1, "x"), (2, [0.9, 0.1], 1, "x"), (3, [0.0, 1.0], 1, "x"), (4, None, 1, "x"), (5, [], 1, "x"), (6, [1.0], 1, "x"), (7, [nan, 1.0], 1, "x"), (8, [None, 1.0], 1, "x"), (None, [1.0, 0.0], 1, "x")]
    got = {(r["vec_id"], r["neighbor_id"]) for r in search(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {(a, b) for a in (1, 2, 3) for b in (1, 2, 3) if a != b}
    for few in ([], rows[:1]):
        out = search(spark.createDataFrame(few, SCHEMA))
        assert out.columns == ["vec_id", "neighbor_id", "rank", "distance"] and out.count() == 0


@pytest.mark.parametrize("n", [500, 3000])
def test_recall(spark, n):
    x = np.random.default_rng(4).normal(size=(n, 64))
    got = {(r["vec_id"], r["neighbor_id"]) for r in ann.neighbours(frame(spark, x)).collect()}
    u = x.astype(np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    want = {(i, int(j)) for i in range(n) for j in np.argsort(-s[i])[:10]}
    assert len(got & want) >= 0.9 * len(want)


def _recall(got, x, asked, k):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u[asked] @ u.T
    s[np.arange(len(asked)), asked] = -2
    found = {(r["vec_id"], r["neighbor_id"]) for r in got}
    return np.mean([(int(i), int(j)) in found for i, row in zip(asked, s) for j in np.argsort(-row)[:k]])


def test_recall_of_queries_unlike_other_rows(spark):
    rng = np.random.default_rng(8)
    x = (rng.normal(size=(750, 1, 64)) + 0.05 * rng.normal(size=(750, 8, 64))).reshape(-1, 64)  # clusters of 8, where a probe is enough
    asked = np.arange(0, len(x), 50)
    x[asked] = rng.normal(size=(len(asked), 64))  # the queries lie apart
    got = ann.neighbours(frame(spark, x), k=5, sample=30, every=50).collect()
    assert {r["vec_id"] for r in got} == set(asked.tolist()) and _recall(got, x, asked, 5) >= 0.9


def test_op3_asks_for_every_fiftieth_row(spark):
    import __spark_entry__ as entry

    got = entry.queries()["op3_cross_polytope"](spark, "/root/testdata/sf0.001").collect()
    x = np.array([r["embedding"] for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").orderBy("vec_id").collect()])
    asked = np.arange(0, len(x), 50)
    assert {r["vec_id"] for r in got} == set(asked.tolist()) and _recall(got, x, asked, 10) >= 0.9


def test_fewest_probes():
    q, rank = np.repeat(np.arange(20), 10), np.tile(np.arange(10), 20)
    assert ann.fewest(q, rank, 20, 0.93, 10) == 10 and ann.fewest(q, rank, 20, 0.5, 10) == 9  # 0.9 at least, known of all queries
    rank[100:] += 5  # the second lot needs more than the one before
    assert ann.fewest(q, rank, 20, 0.93, 10) == 15
    rank = np.where(q == 3, 40, 0)  # 19 of 20 queries are met at once, but of more queries that is too little to go by
    assert ann.fewest(q, rank, 20, 0.9, 20) == 1 and ann.fewest(q, rank, 1000, 0.9, 20) == 41


def test_given_probes_and_two_hashes(spark):
    x = np.random.default_rng(6).normal(size=(400, 8))
    x[7] = 0  # no direction
    every = {tuple(r) for r in ann.neighbours(frame(spark, x), tables=1, hashes=1, probes=16).collect()}
    keep = np.delete(np.arange(400), 7)
    assert every == brute(x[keep], keep, 10, True)  # all 16 buckets of a table are all vectors
    few = {tuple(r) for r in ann.neighbours(frame(spark, x), tables=4, hashes=2, probes=3).collect()}
    assert few and not any(7 in r[:2] for r in every | few)


def test_ties_go_to_the_smaller_id(spark):
    x = np.tile([[1.0, 0.0], [0.0, 1.0]], (12, 1))
    assert {tuple(r) for r in ann.neighbours(frame(spark, x), k=5).collect()} == brute(x, np.arange(24), 5, True)


def test_close_neighbours_need_less_work_than_all_pairs(spark):
    rng = np.random.default_rng(12)
    x = (rng.normal(size=(1500, 1, 64)) + 0.15 * rng.normal(size=(1500, 8, 64))).reshape(-1, 64)  # 12,000 in clusters of 8
    rows = frame(spark, x)
    units = spark.createDataFrame([(i, v.astype(np.float32).tobytes()) for i, v in enumerate(x / np.linalg.norm(x, axis=1, keepdims=True))], "vec_id long, unit binary")
    hashes, probes = ann.plan(units, len(x), 64, 64, 7, 16, 0.93, 256)
    assert 16 * probes / 128**hashes < 0.2
    got = {(r["vec_id"], r["neighbor_id"]) for r in ann.neighbours(rows, k=7).collect()}
    want = {(i, j) for i in range(len(x)) for j in range(i // 8 * 8, i // 8 * 8 + 8) if i != j}
    assert len(got & want) >= 0.9 * len(want)


def test_ranks_of_buckets():
    x = np.random.default_rng(3).normal(size=(40, 16))
    for hashes in (1, 2):
        rank = ann._ranks(x[:20], x[20:], 2, hashes)
        for i in range(20):
            places = []
            for t in range(2):
                order = ann.buckets(x[i : i + 1], t, hashes, 32**hashes)[0].tolist()
                places.append(order.index(ann.buckets(x[20 + i : 21 + i], t, hashes, 1)[0, 0]))
            assert abs(min(places) - rank[i]) <= hashes - 1  # sums of two differ by rounding


def test_hadamard_keeps_lengths():
    x = np.random.default_rng(2).normal(size=(5, 16))
    assert np.allclose(np.linalg.norm(ann.rotate(x, 1), axis=1), np.linalg.norm(x, axis=1))
    assert np.allclose(ann.hadamard(ann.hadamard(x)), x)
