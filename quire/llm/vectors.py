"""What both vector searches share: usable rows, numpy views of them, and the exact distances by which results are ranked.

Ids are whole numbers. Rows without an id, or whose vector is null, empty, of another length than the most common one, or has
parts that are null, infinite or no number, take no part in a search. Of several vectors under one id the least (as an array) counts, so that repeated rows are
one. Distances are rounded to 6 digits and ties go to the smaller id. Columns other than vec_id and embedding are never read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIGITS = 6


def sound(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding (array<float>) of the rows with an id and a vector of finite parts."""
    e = F.col("embedding")
    return vectors.select("vec_id", e.cast("array<float>").alias("embedding")).where("vec_id is not null and size(embedding) > 0").where(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))))


def usable(vectors: DataFrame) -> tuple[DataFrame, int, int]:
    """vec_id and embedding (array<float>) of the rows that take part, their number and dimension."""
    rows = sound(vectors)
    sizes = rows.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n")).collect()
    if not sizes:
        return rows, 0, 0
    dim, n = max(((r["d"], r["n"]) for r in sizes), key=lambda x: (x[1], x[0]))
    return rows.where(F.size("embedding") == dim).groupBy("vec_id").agg(F.min("embedding").alias("embedding")), n, dim


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten()).reshape(-1, dim).astype(np.float64)


def lists(ids: np.ndarray, values: np.ndarray, owner: np.ndarray, n: int) -> tuple[pa.Array, pa.Array]:
    """n lists of ids and n of distances; rows of one owner follow one another, owners in order."""
    ends = pa.array(np.searchsorted(owner, np.arange(n + 1)).astype(np.int32))
    return pa.ListArray.from_arrays(ends, pa.array(ids)), pa.ListArray.from_arrays(ends, pa.array(values))


FOUND = "ids array<bigint>, ds array<double>"


def nearest(ids: np.ndarray, distance: np.ndarray, query: np.ndarray, k: int) -> np.ndarray:
    """Of candidates (query, id, distance) the order in which each query's best k come, queries in order."""
    order = np.lexsort((ids, distance, query))
    q = query[order]
    first = np.flatnonzero(np.concatenate(([True], q[1:] != q[:-1]))) if len(q) else np.zeros(0, np.int64)
    nth = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
    return order[nth < k]


def packed(x: np.ndarray) -> pa.Array:
    """Rows of x as float32 bytes."""
    wide = 4 * x.shape[1]
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(wide), len(x), [None, pa.py_buffer(np.ascontiguousarray(x, np.float32))]).cast(pa.binary())


def unpacked(column: pa.Array, dim: int) -> np.ndarray:
    """What packed() made, as float64."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, dim).astype(np.float64)


def streamed(rows: DataFrame, keys: list[str], search: Callable[[pa.Table, pa.Table], pa.RecordBatch], own: bool, schema: str) -> DataFrame:
    """``search(members, rows)`` for the rows of every block of equal ``keys``, which have a boolean column member.

    A block's members are sorted before its other rows and held; the others pass by in batches, however many they are, so that
    each row is shuffled once for a block and memory holds the members of one block. ``own``: members are searched for too.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held, members = None, [], None

        def ready() -> Iterator[pa.RecordBatch]:
            nonlocal members
            if members is None and held:
                members = pa.Table.from_batches(held)
                if own:
                    for h in held:
                        yield search(members, pa.Table.from_batches([h]))

        for b in batches:
            if not b.num_rows:
                continue
            code = np.stack([np.asarray(b.column(k)).astype(np.int64) for k in keys], 1)
            is_member = np.asarray(b.column("member"))
            cut = np.flatnonzero(np.concatenate(([True], (code[1:] != code[:-1]).any(1) | (is_member[1:] != is_member[:-1]))))
            for a, z in zip(cut.tolist(), [*cut[1:].tolist(), b.num_rows]):
                key = tuple(code[a])
                if key != last:
                    yield from ready()
                    last, held, members = key, [], None
                if is_member[a]:
                    held.append(b.slice(a, z - a))
                else:
                    yield from ready()
                    if members is not None:
                        yield search(members, pa.Table.from_batches([b.slice(a, z - a)]))
        yield from ready()

    return rows.repartition(*keys).sortWithinPartitions(*keys, F.desc("member")).mapInArrow(run, schema)


def _best(k: int):
    @F.arrow_udf("array<struct<d: double, id: bigint>>")
    def best(ids: pa.Array, ds: pa.Array) -> pa.Array:
        ids, ds = (x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in (ids, ds))
        n = np.asarray(ids.value_lengths()).astype(np.int64)
        i, d, q = np.asarray(ids.flatten()), np.asarray(ds.flatten()), np.repeat(np.arange(len(n)), n)
        order = np.lexsort((i, d, q))
        i, d, q = i[order], d[order], q[order]
        new = np.ones(len(i), bool)  # a neighbour comes once for each list that it is in
        new[1:] = (i[1:] != i[:-1]) | (q[1:] != q[:-1])
        i, d, q = i[new], d[new], q[new]
        take = nearest(i, d, q, k)
        ends = pa.array(np.searchsorted(q[take], np.arange(len(n) + 1)).astype(np.int32))
        return pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([pa.array(d[take]), pa.array(i[take])], ["d", "id"]))

    return best


def merge(found: DataFrame, k: int, name: str) -> DataFrame:
    """vec_id, neighbor_id, rank and the distance as ``name`` from lists of candidates (vec_id, ids, ds)."""
    every = found.where(F.size("ids") > 0).groupBy("vec_id").agg(F.collect_list(F.struct("ids", "ds")).alias("l"))
    best = every.select("vec_id", _best(k)(F.flatten("l.ids"), F.flatten("l.ds")).alias("best"))
    return best.select("vec_id", F.posexplode("best").alias("i", "x")).select("vec_id", F.col("x.id").alias("neighbor_id"), (F.col("i") + 1).cast("int").alias("rank"), F.col("x.d").alias(name))
