"""Operator 7, near duplicates by SimHash with a bit-sliced comparison.

Fingerprint: 128 bits, the signs of the sums of the hashes of a document's distinct words and distinct pairs of adjacent
words, letters only and in lower case. Two documents are near copies if their fingerprints differ in at most ``radius``
bits; a group is a connected component of near copies, and the row with the least doc_id of a group stays.

Candidates: each document has ``tables`` keys, each from the least two hashed 4-word shingles under two permutations. Any
two documents that share a key are compared; nothing is capped. At a share s of common shingles a pair meets with a
probability of 1 - (1 - s^2)^tables: 0.99 for s = 0.56 and 12 tables. A document of under ``SHORT`` words loses a larger share of its
shingles by an edit and has as many keys more, of one least shingle each: 1 - (1 - s)^tables. Documents with equal fingerprints are one node.
A key with more than ``most`` nodes is split into parts, and every two parts are compared in a task of their own: all
pairs, whatever the number of documents that share a passage, in bounded memory.

Comparison: the fingerprints of a key's block are stored as bit planes, plane p holding bit p of 64 documents in a word.
A query flips each plane by its own bit, so that a set bit is a difference, and carry-save adders count the differences
of 64 documents at once in vertical counters. After every 16 planes, words in which all exceed the radius are abandoned.

Cases: a null text is in no group and stays; texts without letters, the empty one too, are grouped only with equal texts;
repeated rows are copies of which one stays; of equal doc_ids the text with the least hash stays; a null doc_id comes last.
doc_ids have any type with an order. A word may have any length; texts without spaces between words are one word a line.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import doc_words, drop_dir, materialize, mix64, runs, segments, text_buffers
from quire.llm.components import components

U = np.uint64
BITS, STEP, WIDE, SHORT = 128, 16, 256, 128
#: Bits, the planes between two checks, the size of a block from which it is searched breadth first, words of a short document.
SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1)[:, ::-1].copy().view(np.uint64).ravel()
"""Of each byte its 8 bits in the 8 bytes of a word: 255 of them can be added without a carry between bytes."""


def _signs(key: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of n documents from sorted distinct keys, the document above bit 44 and the feature below."""
    doc, feature = (key >> U(44)).astype(np.int64), mix64(key & U(2**44 - 1))
    total, many = np.zeros((n, BITS), np.int64), np.zeros(n, np.int64)
    for a in range(0, len(key), 1 << 16):
        d, f = doc[a : a + (1 << 16)], feature[a : a + (1 << 16)]
        first = segments(d)
        at = np.arange(len(d)) - np.repeat(first, np.diff(np.append(first, len(d))))
        blocks = np.flatnonzero(at % 255 == 0)
        octets = np.stack([f, mix64(f ^ U(0x5851F42D4C957F2D))], 1).view(np.uint8)
        sums = np.add.reduceat(SPREAD[octets], blocks, axis=0).view(np.uint8).reshape(len(blocks), BITS)
        np.add.at(total, d[blocks], sums)
        many[d[first]] += np.diff(np.append(first, len(d)))
    bits = (2 * total > many[:, None]).astype(np.uint8)
    both = np.packbits(bits, axis=1, bitorder="little").view(U)
    return both[:, 0], both[:, 1]


def fingerprints(column: pa.Array, tables: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Both halves of the fingerprint, the keys (n, 2 * tables; the latter half for short texts only) and the number of words of each text."""
    flat, offs, _ = text_buffers(column)
    n = len(offs) - 1
    low, high, keys, words = np.zeros(n, U), np.zeros(n, U), np.zeros((n, 2 * tables), U), np.zeros(n, np.int64)
    rng = np.random.default_rng(20)
    odd = rng.integers(0, 2**63, 2 * tables, dtype=np.uint64) * U(2) + U(1)
    for a, b in runs(offs):
        h, d = doc_words(flat[offs[a] : offs[b]], offs[a : b + 1] - offs[a])[:2]
        if not len(h):
            continue
        m, first = b - a, segments(d)
        sizes = np.diff(np.append(first, len(d)))
        words[a + d[first]] = sizes
        last = np.repeat(first + sizes, sizes)
        two = np.flatnonzero(np.arange(len(h)) + 1 < last)
        pairs = mix64(h[two] * U(0x9E3779B97F4A7C15) + h[two + 1])
        key = np.concatenate([d.astype(U) << U(44) | h >> U(20), d[two].astype(U) << U(44) | pairs >> U(20)])
        key.sort()
        low[a:b], high[a:b] = _signs(key[np.concatenate(([True], key[1:] != key[:-1]))], m)
        shingle = h.copy()  # those at the end of a document have fewer words; they count only where it has none of four
        for k in range(1, 4):
            i = np.flatnonzero(np.arange(len(h)) + k < last)
            shingle[i] = mix64(shingle[i] * U(0xD6E8FEB86659FD93) + h[i + k])
        whole = (np.arange(len(h)) + 3 < last) | ((np.arange(len(h)) == np.repeat(first, sizes)) & (np.repeat(sizes, sizes) < 4))
        shingle, d = shingle[whole], d[whole]
        first = segments(d)
        for t in range(tables):
            x, y = (np.minimum.reduceat(mix64(shingle * odd[2 * t + i]), first) for i in (0, 1))
            keys[a + d[first], t] = mix64(x ^ (y << U(1)) ^ U(t))
            keys[a + d[first], tables + t] = mix64(x ^ U(tables + t))
    return low, high, keys, words


def fingerprint(tables: int):
    """Column function: text to struct<f0, f1, keys>; null without a text, f0 null where it has no word."""

    @F.arrow_udf("struct<f0: bigint, f1: bigint, keys: array<bigint>>")
    def simhash(text: pa.Array) -> pa.Array:
        low, high, keys, words = fingerprints(text, tables)
        none = words == 0
        has = np.repeat(np.stack([~none, ~none & (words < SHORT)], 1), tables, axis=1)
        count = np.concatenate(([0], np.cumsum(has.sum(1)))).astype(np.int32)
        return pa.StructArray.from_arrays([pa.array(low.view(np.int64), mask=none), pa.array(high.view(np.int64), mask=none), pa.ListArray.from_arrays(pa.array(count), pa.array(keys[has].view(np.int64)))], ["f0", "f1", "keys"], mask=text.is_null() if isinstance(text, pa.Array) else text.combine_chunks().is_null())

    return simhash


class Sliced:
    """Fingerprints of blocks as bit planes: block k has the nodes [offs[k], offs[k + 1])."""

    def __init__(self, f0: np.ndarray, f1: np.ndarray, offs: np.ndarray):
        self.f, self.offs = (f0, f1), offs
        sizes = np.diff(offs)
        words = (sizes + 63) // 64
        self.word0 = np.concatenate(([0], np.cumsum(words)))
        total = int(self.word0[-1])
        self.lane = np.arange(len(f0)) - np.repeat(offs[:-1], sizes) + 64 * np.repeat(self.word0[:-1], sizes)
        self.node = np.full(64 * total, -1)
        self.node[self.lane] = np.arange(len(f0))
        self.used = np.packbits((self.node >= 0).astype(np.uint8), bitorder="little").view(U)
        self.planes = np.empty((BITS, total), U)
        for half, f in enumerate(self.f):
            lanes = np.zeros(64 * total, U)
            lanes[self.lane] = f
            bits = np.unpackbits(lanes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").reshape(total, 64, 64)
            self.planes[64 * half : 64 * half + 64] = np.packbits(bits.transpose(2, 0, 1), axis=2, bitorder="little").reshape(64, total, 8).view(U)[:, :, 0]

    def near(self, query: np.ndarray, word: np.ndarray, radius: int, used: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Nodes (q, other) within the radius, for pairs of a query node and a word of planes."""
        used = self.used if used is None else used
        live = np.arange(len(query))
        count = [np.zeros(len(query), U) for _ in range(8)]  # vertical counters, lowest bit first
        for at in range(0, BITS, STEP):
            f = self.f[at // 64][query[live]]
            w = word[live]
            rest: list[list[np.ndarray]] = [[self.planes[at + p][w] ^ (U(0) - ((f >> U((at + p) % 64)) & U(1))) for p in range(STEP)], *([] for _ in range(8))]
            for k in range(8):  # carry-save adders: three of a weight become one of it and one of the next
                own = [count[k], *rest[k]]
                while len(own) > 1:
                    a, b = own.pop(), own.pop()
                    if own:
                        c = own.pop()
                        x = a ^ b
                        own.insert(0, x ^ c)
                        rest[k + 1].append((a & b) | (x & c))
                    else:
                        own.append(a ^ b)
                        rest[k + 1].append(a & b)
                count[k] = own[0]
            more, equal = np.zeros(len(live), U), np.full(len(live), ~U(0), U)
            for k in range(7, -1, -1):
                if radius >> k & 1:
                    equal = equal & count[k]
                else:
                    more, equal = more | (equal & count[k]), equal & ~count[k]
            within = ~more & used[w]
            stay = np.flatnonzero(within)
            live, within, count = live[stay], within[stay], [c[stay] for c in count]
            if not len(live):
                return np.zeros(0, np.int64), np.zeros(0, np.int64)
        bits = np.unpackbits(within.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        i, lane = np.nonzero(bits)
        return query[live[i]], self.node[64 * word[live[i]] + lane]


def forest(f0: np.ndarray, f1: np.ndarray, offs: np.ndarray, radius: int) -> np.ndarray:
    """Of every node the least node of its component within its block. Blocks are [offs[k], offs[k + 1])."""
    label = np.arange(len(f0))
    sizes = np.diff(offs)
    small = np.flatnonzero(sizes <= WIDE)
    a = 0
    while a < len(small):  # small blocks together: every node against its block
        cost = np.cumsum(sizes[small[a:]] * ((sizes[small[a:]] + 63) // 64))
        b = a + max(1, int(np.searchsorted(cost, 1 << 15, "right")))
        some = small[a:b]
        take = np.repeat(offs[some] - np.cumsum(sizes[some]) + sizes[some], sizes[some]) + np.arange(sizes[some].sum())
        s = Sliced(f0[take], f1[take], np.concatenate(([0], np.cumsum(sizes[some]))))
        words = np.diff(s.word0)
        per = np.repeat(words, sizes[some])
        query = np.repeat(np.arange(len(take)), per)
        word = np.repeat(np.repeat(s.word0[:-1], sizes[some]) - np.cumsum(per) + per, per) + np.arange(per.sum())
        i, j = s.near(query, word, radius)
        own = np.arange(len(take))
        while True:
            new = own.copy()
            np.minimum.at(new, i, own[j])
            new = np.minimum(new, new[new])
            if (new == own).all():
                break
            own = new
        label[take] = take[own]
        a = b
    for k in np.flatnonzero(sizes > WIDE):  # a large one breadth first: only nodes that no component has yet are compared
        o, m = int(offs[k]), int(sizes[k])
        s = Sliced(f0[o : o + m], f1[o : o + m], np.array([0, m]))
        used = s.used.copy()
        for root in range(m):
            if not used[root >> 6] >> U(root & 63) & U(1):
                continue
            front = np.array([root])
            used[root >> 6] &= ~(U(1) << U(root & 63))
            while len(front):
                words, found = np.flatnonzero(used), []
                if not len(words):
                    break
                for f in range(0, len(front), max(1, (1 << 15) // len(words))):
                    part = front[f : f + max(1, (1 << 15) // len(words))]
                    _, j = s.near(np.repeat(part, len(words)), np.tile(words, len(part)), radius, used)
                    found.append(j)
                front = np.unique(np.concatenate(found))
                label[o + front] = o + root
                np.bitwise_and.at(used, front >> 6, ~(U(1) << (front & 63).astype(U)))
    return label


def forest_edges(radius: int):
    """Column function: the nodes of a block to edges (a0, a1) - (b0, b1) that span its components."""

    @F.arrow_udf("array<struct<a0: bigint, a1: bigint, b0: bigint, b1: bigint>>")
    def edges(nodes: pa.Array) -> pa.Array:
        nodes = nodes.combine_chunks() if isinstance(nodes, pa.ChunkedArray) else nodes
        flat = nodes.flatten()
        f0, f1 = (np.asarray(flat.field(k)).astype(np.int64) for k in (0, 1))
        offs = np.concatenate(([0], np.cumsum(np.asarray(nodes.value_lengths()).astype(np.int64))))
        to = forest(f0.view(U), f1.view(U), offs, radius)
        moved = np.flatnonzero(to != np.arange(len(to)))
        ends = np.searchsorted(moved, offs).astype(np.int32)
        rows = pa.StructArray.from_arrays([pa.array(x) for x in (f0[moved], f1[moved], f0[to[moved]], f1[to[moved]])], ["a0", "a1", "b0", "b1"])
        return pa.ListArray.from_arrays(pa.array(ends), rows)

    return edges


def _keys():
    """Two columns that tell rows apart: equal for rows that have doc_id and text in common, never null."""
    return F.xxhash64("doc_id", "text").alias("k1"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("k2")


def blocks_of(keyed: DataFrame, most: int) -> DataFrame:
    """nodes of every block from distinct rows (f0, f1, key): a key's, or two parts of a key that has more than ``most``."""
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key", F.ceil(F.col("n") / most).alias("parts"))
    node = keyed.join(sizes, "key")
    own = F.pmod(F.xxhash64("f0", "f1"), "parts")
    pair = F.expr("transform(sequence(0L, parts - 1), i -> struct(least(i, own) as i, greatest(i, own) as j))")
    tiles = node.withColumn("own", own).select("f0", "f1", "key", F.explode(pair).alias("tile"))
    return tiles.groupBy("key", "tile").agg(F.collect_list(F.struct("f0", "f1")).alias("nodes")).where(F.size("nodes") > 1)


def near_groups(docs: DataFrame, radius: int = 26, tables: int = 12, most: int = 16384) -> DataFrame:
    """k1, k2, doc_id, group_id (least doc_id of the group), group_size and keep of every row of docs. Computed at once."""
    spark = docs.sparkSession
    slim = docs.select("doc_id", *_keys(), F.xxhash64("text").alias("th"), F.xxhash64(F.lit(1), "text").alias("tg"), F.col("text").isNull().alias("void"), fingerprint(tables)("text").alias("x"))
    slim = slim.select("doc_id", "k1", "k2", "void", "th", F.monotonically_increasing_id().alias("rid"), F.coalesce("x.f0", "th").alias("f0"), F.coalesce("x.f1", "tg").alias("f1"), "x.keys")
    slim, at = materialize(slim, "simhash")
    blocks = blocks_of(slim.select("f0", "f1", F.explode("keys").alias("key")).distinct(), most)
    found = blocks.select(F.explode(forest_edges(radius)("nodes")).alias("e"))
    root = components(found.select(F.struct(F.col("e.a0").alias("f0"), F.col("e.a1").alias("f1")).alias("a"), F.struct(F.col("e.b0").alias("f0"), F.col("e.b1").alias("f1")).alias("b")))
    root = root.select(F.col("node.f0").alias("f0"), F.col("node.f1").alias("f1"), "root")
    rows = slim.drop("keys").where("not void").join(root, ["f0", "f1"], "left").withColumn("root", F.coalesce("root", F.struct("f0", "f1")))
    first = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "th", "rid")).alias("m"), F.count("*").alias("group_size"))
    grouped = rows.join(first, "root").select("k1", "k2", "doc_id", F.col("m.doc_id").alias("group_id"), "group_size", (F.col("rid") == F.col("m.rid")).alias("keep"))
    alone = slim.where("void").select("k1", "k2", "doc_id", F.col("doc_id").alias("group_id"), F.lit(1).cast("bigint").alias("group_size"), F.lit(True).alias("keep"))
    out, _ = materialize(grouped.unionAll(alone), "groups")
    drop_dir(spark, at)
    return out


def near_duplicates(docs: DataFrame, radius: int = 26, tables: int = 12) -> DataFrame:
    """doc_id, group_id, group_size and keep of every row of docs."""
    return near_groups(docs, radius, tables).drop("k1", "k2")


def drop_near_duplicates(docs: DataFrame, radius: int = 26, tables: int = 12) -> DataFrame:
    """The rows of docs that stay, with its columns. The text moves once, for the join with the decisions."""
    stay = near_groups(docs, radius, tables).where("keep").groupBy("k1", "k2").agg(F.count("*").alias("n"))
    rows = docs.select(F.struct("*").alias("row"), *_keys()).join(stay, ["k1", "k2"])
    # rows that have doc_id and text in common are copies, of which one stays; those without a text all stay
    nth = F.row_number().over(Window.partitionBy("k1", "k2").orderBy("k1"))
    return rows.withColumn("nth", nth).where("nth <= n").select("row.*")
