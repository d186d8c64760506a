"""Operator 4, BPE encoding and decoding in batched numpy merge rounds.

A vocabulary of ranks defines the merges: two adjacent symbols merge if their joined bytes are a token, lowest rank first.
All pairs (left, right) that make a token are kept as sorted 64-bit keys. The symbols of many words lie in one flat array;
in a round, each adjacent pair of a word is looked up by binary search, the lowest rank of every word is found by a
segmented minimum, its occurrences merge from the left, and words without a pair leave the array. A word of over ``LONG`` bytes
would need a round for nearly each of its merges; its pairs wait in a heap instead, by rank and position, which merges in the same order. Distinct words are
merged once for a worker and their tokens gathered for every occurrence. Decoding gathers the bytes of the tokens.

Cases: a null text has null tokens, an empty one has none; special tokens' strings are ordinary text; texts are encoded
whole, whatever their length; a row's tokens don't depend on other rows, so repeated rows have the same ones. Ids outside
the vocabulary are an error in decoding; bytes that aren't UTF-8 become U+FFFD.
"""

from __future__ import annotations

import base64
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import runs, text_buffers

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
NONE = np.int32(2**31 - 1)
LONG = 1024
MOST_WORDS = 200_000
"""Distinct words whose tokens a worker remembers; beyond that it starts afresh, which costs time only."""


def _spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions of the ranges that begin at ``starts``, one after another."""
    return np.repeat(starts - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())


class Bpe:
    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.pattern = regex.compile(pattern)
        size = max(ranks.values()) + 1
        tokens = [b""] * size
        for t, r in ranks.items():
            tokens[r] = t
        self.byte = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        self.width = np.array([len(t) for t in tokens], np.int64)
        self.start = np.concatenate(([0], np.cumsum(self.width)[:-1]))
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        pairs = [(ranks[t[:i]] << 32 | ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        keys, values = np.array([p[0] for p in pairs], np.int64), np.array([p[1] for p in pairs], np.int32)
        order = np.argsort(keys)
        self.keys, self.values, self.table = keys[order], values[order], None
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.length, self.first, self.tokens, self.used = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(4096, np.int32), 0

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all words, flat, and the number of tokens of each. No word is empty."""
        long = [i for i, w in enumerate(words) if len(w) > LONG]
        if not long:
            return self.rounds(words)
        short = [i for i, w in enumerate(words) if len(w) <= LONG]
        tokens, n = self.rounds([words[i] for i in short])
        ends = np.cumsum(n)
        each = dict(zip(short, (tokens[e - m : e] for e, m in zip(ends, n)))) | {i: self.merge_long(words[i]) for i in long}
        parts = [each[i] for i in range(len(words))]
        return np.concatenate(parts), np.array([len(p) for p in parts], np.int64)

    def merge_long(self, word: bytes) -> np.ndarray:
        """Tokens of one word, its pairs in a heap by rank and position."""
        if self.table is None:
            self.table = dict(zip(self.keys.tolist(), self.values.tolist()))
        rank_of, sym = self.table, self.byte[np.frombuffer(word, np.uint8)].tolist()
        n = len(sym)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := rank_of.get(sym[i] << 32 | sym[i + 1])) is not None]
        heapify(heap)
        while heap:
            r, i = heappop(heap)
            j = after[i] if sym[i] >= 0 else n
            if j >= n or rank_of.get(sym[i] << 32 | sym[j]) != r:
                continue  # one of the two has merged since
            sym[i], sym[j] = r, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                if (x := rank_of.get(r << 32 | sym[after[i]])) is not None:
                    heappush(heap, (x, i))
            if before[i] >= 0 and (x := rank_of.get(sym[before[i]] << 32 | r)) is not None:
                heappush(heap, (x, before[i]))
        return np.array([s for s in sym if s >= 0], np.int32)

    def rounds(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """As merge(), by rounds over the symbols of all words at once."""
        lengths = np.array([len(w) for w in words], np.int64)
        sym = self.byte[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), lengths)
        out, at = np.empty(len(sym), np.int32), np.zeros(len(words), np.int64)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(sym):
            key = sym[:-1].astype(np.int64) << 32 | sym[1:]
            i = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rank = np.append(np.where((self.keys[i] == key) & (word[:-1] == word[1:]), self.values[i], NONE), NONE).astype(np.int32)
            first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            low = np.minimum.reduceat(rank, first)
            sizes = np.diff(np.append(first, len(sym)))
            ended = np.repeat(low == NONE, sizes)
            if ended.any():
                done.append((sym[ended], word[ended]))
            hit = (rank == np.repeat(low, sizes)) & ~ended
            # of hits one after another, every other one from the left merges
            pos = np.flatnonzero(hit)
            fresh = np.concatenate(([True], (np.diff(pos) > 1) | (word[pos[1:]] != word[pos[:-1]]))) if len(pos) else np.zeros(0, bool)
            since = np.arange(len(pos)) - np.maximum.accumulate(np.where(fresh, np.arange(len(pos)), 0)) if len(pos) else pos
            pos = pos[since % 2 == 0]
            sym = sym.copy()
            sym[pos] = rank[pos]
            keep = ~ended
            keep[pos + 1] = False
            sym, word = sym[keep], word[keep]
        if done:
            syms, ids = np.concatenate([d[0] for d in done]), np.concatenate([d[1] for d in done])
            order = np.argsort(ids, kind="stable")
            out, at = syms[order], np.bincount(ids, minlength=len(words))
        return out[: int(at.sum())], at

    def learn(self, words: list[str]) -> None:
        """Merge new words and remember their tokens."""
        tokens, n = self.merge([w.encode() for w in words])
        have, need = len(self.index) - len(words), len(self.index)
        if need > len(self.length):
            self.length, self.first = (np.concatenate([x, np.zeros(max(need, len(x)), np.int64)]) for x in (self.length, self.first))
        if self.used + len(tokens) > len(self.tokens):
            self.tokens = np.concatenate([self.tokens, np.zeros(max(len(tokens), len(self.tokens)), np.int32)])
        self.length[have:need] = n
        self.first[have:need] = self.used + np.cumsum(n) - n
        self.tokens[self.used : self.used + len(tokens)] = tokens
        self.used += len(tokens)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all texts, flat, and the number of tokens of each."""
        if len(self.index) > MOST_WORDS:
            self.forget()
        find, index = self.pattern.findall, self.index
        each = [find(t) for t in texts]
        counts = np.array([len(w) for w in each], np.int64)
        words = [w for ws in each for w in ws]
        new = [w for w in dict.fromkeys(words) if w not in index]
        if new:
            index.update(zip(new, range(len(index), len(index) + len(new))))
            self.learn(new)
        i = np.fromiter(map(index.__getitem__, words), np.int64, len(words))
        n = self.length[i]
        total = np.concatenate(([0], np.cumsum(n)))
        ends = np.cumsum(counts)
        return self.tokens[_spread(self.first[i], n)], total[ends] - total[ends - counts]

    def decode(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all tokens, flat, and the number of bytes of each token."""
        n = self.width[tokens]
        return self.bytes[_spread(self.start[tokens], n)], n


@lru_cache(2)
def load(path: str = VOCABULARY, pattern: str = PATTERN) -> Bpe:
    return Bpe(path, pattern)


def encoder(path: str = VOCABULARY, pattern: str = PATTERN):
    """Column function: text to struct<token_ids, n_tokens, round_trip>; the last says that decoding gives the text."""

    @F.arrow_udf("struct<token_ids: array<int>, n_tokens: int, round_trip: boolean>")
    def bpe_encode(text: pa.Array) -> pa.Array:
        bpe, (flat, offs, valid) = load(path, pattern), text_buffers(text)
        ids, counts, same = [], [], []
        for a, b in runs(offs):
            whole = flat[offs[a] : offs[b]].tobytes()
            at = offs[a : b + 1] - offs[a]
            tokens, n = bpe.encode([whole[i:j].decode() for i, j in zip(at[:-1].tolist(), at[1:].tolist())])
            back, width = bpe.decode(tokens)
            if back.tobytes() == whole and np.array_equal(np.concatenate(([0], np.cumsum(width)))[np.cumsum(n)], at[1:]):
                same.append(np.ones(b - a, bool))
            else:
                cut = np.concatenate(([0], np.concatenate(([0], np.cumsum(width)))[np.cumsum(n)]))
                same.append(np.array([back[cut[k] : cut[k + 1]].tobytes() == whole[at[k] : at[k + 1]] for k in range(b - a)]))
            ids.append(tokens)
            counts.append(n)
        n = np.concatenate([*counts, np.zeros(0, np.int64)])
        null = pa.array(~valid)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))).astype(np.int32)), pa.array(np.concatenate([*ids, np.zeros(0, np.int32)])), mask=null)
        return pa.StructArray.from_arrays([lists, pa.array(n.astype(np.int32), mask=~valid), pa.array(np.concatenate([*same, np.zeros(0, bool)]), mask=~valid)], ["token_ids", "n_tokens", "round_trip"])

    return bpe_encode


def decoder(path: str = VOCABULARY, pattern: str = PATTERN):
    """Column function: array of token ids to text."""

    @F.arrow_udf("string")
    def bpe_decode(token_ids: pa.Array) -> pa.Array:
        bpe = load(path, pattern)
        if isinstance(token_ids, pa.ChunkedArray):
            token_ids = token_ids.combine_chunks()
        n = np.asarray(token_ids.value_lengths().fill_null(0)).astype(np.int64)
        back, width = bpe.decode(np.asarray(token_ids.flatten()))
        ends = np.concatenate(([0], np.cumsum(width)))[np.concatenate(([0], np.cumsum(n)))]
        null = np.asarray(token_ids.is_null())
        whole = back.tobytes()
        return pa.array([None if no else whole[i:j].decode(errors="replace") for no, i, j in zip(null, ends[:-1].tolist(), ends[1:].tolist())], pa.string())

    return bpe_decode


def encode_documents(docs: DataFrame, path: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """doc_id, n_tokens, token_ids and round_trip of every row of docs."""
    return docs.select("doc_id", encoder(path, pattern)("text").alias("x")).select("doc_id", "x.n_tokens", "x.token_ids", "x.round_trip")


def decode_documents(encoded: DataFrame, path: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """doc_id and text of rows that have doc_id and token_ids."""
    return encoded.select("doc_id", decoder(path, pattern)("token_ids").alias("text"))
