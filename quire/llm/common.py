"""What the operators share: tables, the shared folder, views of Arrow text buffers.

Conventions of every operator here: a null text gives a null result (it is never dropped silently), an empty text is a
text of length 0, repeated rows are rows of their own, an empty table gives an empty table, and columns that an operator
doesn't name are never read, so that their names can't clash with internal ones.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PIECE = 1 << 20
"""Bytes of text that a vectorised pass holds at once; it bounds memory whatever the length of a document."""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``, of the session or the context.

    Where it is unset a temporary folder of this machine is taken if the session runs on this machine alone, as in tests; on a
    cluster that is an error, as executors don't share such a folder.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at
    context = spark.sparkContext
    set_ = context._jsc.sc().getCheckpointDir()
    if set_.isDefined():
        return set_.get()
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    at = "file://" + tempfile.mkdtemp(prefix="quire-")
    context.setCheckpointDir(at)
    return at


_made: list[list[str]] = []


def new_dir(spark: SparkSession, tag: str) -> str:
    at = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    for found in _made:
        found.append(at)
    return at


@contextmanager
def made() -> Iterator[list[str]]:
    """The folders that are made within, so that their owner can drop them."""
    found: list[str] = []
    _made.append(found)
    try:
        yield found
    finally:
        _made.remove(found)


def drop_dir(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def materialize(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """Write df to the shared folder and read it back: lineage is cut, and a lost executor costs a reread only."""
    path = new_dir(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """UTF-8 bytes, int64 offsets (n + 1) and validity of a string array, without copies of the text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64), np.zeros(0, bool)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    flat = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None and offs[-1] > offs[0] else np.zeros(0, np.uint8)
    return flat, offs - offs[0], ~np.asarray(column.is_null())


def runs(offs: np.ndarray, most: int = PIECE) -> Iterator[tuple[int, int]]:
    """Consecutive rows [a, b) of at most ``most`` bytes together, or one longer row."""
    a, n = 0, len(offs) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offs, offs[a] + most, "right")) - 1)
        yield a, b
        a = b


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64 on uint64 values."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


LOWER = np.arange(256, dtype=np.uint8)
"""Byte classes for subwords: ASCII letters in lower case, bytes of other letters as they are, everything else 32."""
LOWER[:128] = 32
for _c in range(26):
    LOWER[97 + _c] = LOWER[65 + _c] = 97 + _c


def fold_bytes(flat: np.ndarray) -> np.ndarray:
    """Lower case (ASCII and Latin-1 letters in UTF-8); ASCII bytes that aren't letters become spaces."""
    b = LOWER[flat]
    if len(b) > 1:
        up = np.flatnonzero((flat[:-1] == 0xC3) & (flat[1:] >= 0x80) & (flat[1:] <= 0x9E) & (flat[1:] != 0x97)) + 1
        b[up] += 32
    return b


def words_of(b: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes other than 32; no run crosses a position in ``first``."""
    letter = b != 32
    edge = np.zeros(len(b) + 1, bool)
    edge[first[first <= len(b)]] = True
    before = np.zeros(len(b), bool)
    before[1:] = letter[:-1]
    start = letter & (~before | edge[:-1])
    after = np.zeros(len(b), bool)
    after[:-1] = letter[1:]
    end = letter & (~after | edge[1:])
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def _powers(n: int) -> np.ndarray:
    p = np.full(n, 0x9E3779B97F4A7C15, np.uint64)
    p[:1] = 1
    return np.multiply.accumulate(p) if n else p


def word_sums(b: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A polynomial over the bytes of every word."""
    if not len(start):
        return np.zeros(0, np.uint64)
    lengths = end - start
    pos = np.repeat(start - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths) + np.arange(lengths.sum())
    k = pos - np.repeat(start, lengths)
    value = (b[pos].astype(np.uint64) + np.uint64(1)) * _powers(int(lengths.max()))[k]
    return np.add.reduceat(value, np.concatenate(([0], np.cumsum(lengths)[:-1])))


def word_hashes(b: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of every word: the polynomial over its bytes, mixed with its length."""
    return mix64(word_sums(b, start, end) + (end - start).astype(np.uint64))


def segments(group: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    return np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1]))) if len(group) else np.zeros(0, np.int64)


def doc_words(flat: np.ndarray, offs: np.ndarray, fold=fold_bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, document and first byte of every word, made in pieces; a word longer than a piece is summed up over its pieces.

    ``fold`` maps bytes to bytes; words are the runs of bytes that it doesn't make 32.
    """
    sums, lengths, docs, starts, a, n = [], [], [], [], 0, len(flat)
    base = np.uint64(0x9E3779B97F4A7C15)
    while a < n:
        z = min(n, a + PIECE)
        if z < n:
            cut, ends = np.flatnonzero(fold(flat[a:z]) == 32), offs[(offs > a) & (offs <= z)]
            to = max(int(cut[-1]) if len(cut) else 0, int(ends[-1] - a) if len(ends) else 0)
            while not to and z > a + 4 and flat[z] & 0xC0 == 0x80:  # within a word, but not within a letter of it
                z -= 1
            z = a + to if to else z
        b = fold(flat[a:z])
        s, e = words_of(b, offs[(offs >= a) & (offs <= z)] - a)
        total, size, at = word_sums(b, s, e), e - s, s + a
        doc = np.searchsorted(offs, at, "right") - 1
        if len(s) and len(sums) and at[0] == a and starts[-1][-1] + lengths[-1][-1] == a and docs[-1][-1] == doc[0]:
            before = int(lengths[-1][-1])  # this piece begins within the last word of the one before
            with np.errstate(over="ignore"):
                sums[-1][-1] += np.uint64(pow(int(base), before, 1 << 64)) * total[0]
            lengths[-1][-1] += size[0]
            total, size, doc, at = total[1:], size[1:], doc[1:], at[1:]
        if len(at):
            sums.append(total)
            lengths.append(size)
            docs.append(doc)
            starts.append(at)
        a = z
    none = np.zeros(0, np.int64)
    return mix64(np.concatenate([*sums, np.zeros(0, np.uint64)]) + np.concatenate([*lengths, none]).astype(np.uint64)), np.concatenate([*docs, none]), np.concatenate([*starts, none])


def student(share: float, free: int) -> float:
    """Quantile of Student's distribution, by its expansion from the normal one."""
    z, n = NormalDist().inv_cdf(share), max(1, free)
    return z + (z**3 + z) / (4 * n) + (5 * z**5 + 16 * z**3 + 3 * z) / (96 * n * n)


def local_rows(spark: SparkSession, rows: list[tuple], schema: str, most: int = 50_000) -> DataFrame:
    """Rows that the driver holds, to be joined: broadcast up to ``most`` of them, and otherwise joined as Spark sees fit."""
    df = spark.createDataFrame(rows, schema)
    return F.broadcast(df) if len(rows) <= most else df
