"""Byte-level BPE by rounds over padded matrices.

Distinct pre-tokens of a batch that the worker has not met yet are bucketed by byte length and laid out as padded
integer matrices, one row a pre-token. Each round looks every adjacent pair of ids up in a hashed table of ranks,
merges in each row the leftmost pair of least rank, and compacts the rows; a row without a ranked pair is done and
leaves the matrix. Pre-tokens above `LONG` bytes (where a merge a round would cost the square of the length) take the
same merges in the same order from a heap over a linked list.

A merge of ids (a, b) has the rank of their joined bytes, so both ways give the ids of the reference library.

Defined cases: a null text is empty and gives no ids; an empty table gives no rows; repeated rows, null keys and other
columns (of any name) have no influence.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwright.llm._text import U64, gather, mix64, small_batches, utf8

LONG = 256
CACHE = 1 << 19
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class Ranks:
    """A rank file as an open-addressing hash table from pairs of ids to the id of their join, and ids to bytes."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.rank = rank
        size = max(rank.values()) + 1
        tokens: list[bytes] = [b""] * size
        for k, v in rank.items():
            tokens[v] = k
        self.byte = np.array([rank[bytes([b])] for b in range(256)], np.int32)
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum([len(x) for x in tokens])])
        digits = [b"%d " % i for i in range(size)]
        self.digits = np.frombuffer(b"".join(digits), np.uint8)
        self.digit_offsets = np.concatenate([[0], np.cumsum([len(x) for x in digits])])
        # Every way to split a token into two tokens is a pair that merges to it.
        pairs = [(rank[t[:i]], rank[t[i:]], r) for t, r in rank.items() for i in range(1, len(t)) if t[:i] in rank and t[i:] in rank]
        left, right, to = np.array(pairs, np.int64).reshape(-1, 3).T
        self.pair = dict(zip(zip(left.tolist(), right.tolist(), strict=True), to.tolist(), strict=True))
        self.bits = int(4 * len(pairs) + 1).bit_length()
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, -1, np.int32)
        key = left << 32 | right
        slot = self._slot(key)
        todo = np.arange(len(key))
        while len(todo):
            free = todo[self.keys[slot[todo]] < 0]
            _, first = np.unique(slot[free], return_index=True)
            won = free[first]
            self.keys[slot[won]], self.values[slot[won]] = key[won], to[won]
            todo = np.setdiff1d(todo, won, assume_unique=True)
            slot[todo] = (slot[todo] + 1) & (len(self.keys) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (mix64(key.astype(U64)) >> U64(64 - self.bits)).astype(np.int64)

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The joined id of each pair, or a huge number where the pair has none."""
        key = left.astype(np.int64) << 32 | right
        slot = self._slot(key)
        out = np.full(len(key), 1 << 30, np.int32)
        todo = np.arange(len(key))
        while len(todo):
            here = self.keys[slot[todo]]
            found = here == key[todo]
            out[todo[found]] = self.values[slot[todo[found]]]
            todo = todo[~found & (here >= 0)]
            slot[todo] = (slot[todo] + 1) & (len(self.keys) - 1)
        return out


def encode_matrix(ranks: Ranks, rows: np.ndarray, out: list, where: np.ndarray) -> None:
    """Merges the rows (pre-tokens of one bucket, padded with -1) to the end; out[where[i]] gets row i's ids."""
    none = 1 << 30
    ids = rows
    pair = np.full((len(ids), ids.shape[1]), none, np.int32)
    if ids.shape[1] > 1:
        real = ids[:, 1:] >= 0
        pair[:, :-1][real] = ranks.lookup(ids[:, :-1][real], ids[:, 1:][real])
    while len(ids):
        at = pair.argmin(1)  # the leftmost of the least
        n = np.arange(len(ids))
        best = pair[n, at]
        done = best == none
        for i in np.flatnonzero(done):
            out[where[i]] = ids[i][ids[i] >= 0]
        live = ~done
        ids, pair, at, best, where = ids[live], pair[live], at[live], best[live], where[live]
        if not len(ids):
            return
        n, width = np.arange(len(ids)), ids.shape[1]
        # Compaction: what stands right of the merged pair moves one place to the left.
        col = np.arange(width)[None, :]
        take = np.minimum(col + (col > at[:, None]), width - 1)
        ids = np.take_along_axis(ids, take, 1)
        pair = np.take_along_axis(pair, take, 1)
        ids[:, -1] = -1
        pair[:, -1] = none
        ids[n, at] = best
        for side in (at - 1, at):
            ok = np.flatnonzero((side >= 0) & (side + 1 < width))
            ok_next = ids[ok, np.minimum(side[ok] + 1, width - 1)]
            pair[n[side >= 0], side[side >= 0]] = none
            ok, ok_next = ok[ok_next >= 0], ok_next[ok_next >= 0]
            pair[ok, side[ok]] = ranks.lookup(ids[ok, side[ok]], ok_next)
        keep = max(1, int((ids >= 0).sum(1).max()))
        ids, pair = ids[:, :keep], pair[:, :keep]


def encode_long(ranks: Ranks, token: bytes) -> np.ndarray:
    """The same merges for one long pre-token: a heap of (rank, place) over a doubly linked list."""
    ids = ranks.byte[np.frombuffer(token, np.uint8)].tolist()
    n, get = len(ids), ranks.pair.get
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := get((ids[i], ids[i + 1]))) is not None]
    heapq.heapify(heap)
    while heap:
        r, i, a, b = heapq.heappop(heap)
        j = after[i]
        if j >= n or ids[i] != a or ids[j] != b:
            continue
        ids[i], ids[j] = r, -1
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if (q := get((r, ids[k]))) is not None:
                heapq.heappush(heap, (q, i, r, ids[k]))
        if (k := before[i]) >= 0 and (q := get((ids[k], r))) is not None:
            heapq.heappush(heap, (q, k, ids[k], r))
    return np.array([x for x in ids if x >= 0], np.int32)


def encode_tokens(ranks: Ranks, tokens: list[bytes], cells: int = 1 << 18) -> list[np.ndarray]:
    """The ids of each pre-token. Buckets have one byte length up to 16 and span a quarter of it above."""
    out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(tokens)
    size = np.array([len(t) for t in tokens], np.int64)
    for i in np.flatnonzero(size > LONG):
        out[i] = encode_long(ranks, tokens[i])
    flat = np.frombuffer(b"".join(tokens), np.uint8)
    start = np.concatenate([[0], np.cumsum(size)])[:-1]
    low = 1
    while low <= LONG:
        high = low if low < 16 else min(LONG, low + low // 4)
        mine = np.flatnonzero((size >= low) & (size <= high))
        for at in range(0, len(mine), step := max(1, cells // high)):
            part = mine[at : at + step]
            col = np.arange(high)[None, :]
            place = np.minimum(start[part][:, None] + col, max(0, len(flat) - 1))
            encode_matrix(ranks, np.where(col < size[part][:, None], ranks.byte[flat[place]], -1), out, part)
        low = high + 1
    return out


def decode(ranks: Ranks, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all ids joined, and the ids' offsets in them."""
    return gather(ranks.flat, ranks.offsets, ids)


class Encoder:
    """Splits texts by the pattern and keeps the ids of pre-tokens it has met, up to CACHE of them."""

    def __init__(self, path: str, pattern: str):
        self.ranks, self.split, self.known, self._reset = Ranks(path), regex.compile(pattern).findall, {}, True
        self.flat, self.table = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts joined, and the texts' offsets in them."""
        if len(self.known) > CACHE:
            self.known, self.flat, self.table = {}, np.zeros(0, np.int32), np.zeros(1, np.int64)
        known = self.known
        parts = [self.split(t) for t in texts]
        fresh = list(set(chain.from_iterable(parts)).difference(known))
        if fresh:
            ids = encode_tokens(self.ranks, [t.encode() for t in fresh])
            known.update(zip(fresh, range(len(known), len(known) + len(fresh)), strict=True))
            self.flat = np.concatenate([self.flat, *ids])
            self.table = np.concatenate([self.table, self.table[-1] + np.cumsum([len(x) for x in ids])])
        n = np.fromiter(map(len, parts), np.int64, len(parts))
        picks = np.fromiter(map(known.__getitem__, chain.from_iterable(parts)), np.int64, int(n.sum()))
        ids, off = gather(self.flat, self.table, picks)
        return ids, off[np.concatenate([[0], np.cumsum(n)])]


_loaded: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, pattern: str) -> Encoder:
    """One for each worker process."""
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = Encoder(path, pattern)
    return _loaded[path, pattern]


def ranges(texts: list[str], limit: int) -> Iterator[list[str]]:
    some, size = [], 0
    for t in texts:
        some.append(t)
        size += len(t)
        if size >= limit:
            yield some
            some, size = [], 0
    if some:
        yield some


def bpe_round_trip(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encodes every whole text, decodes its ids, and returns digests of both."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, pattern)
        for b in batches:
            texts = b.column(1).fill_null("").to_pylist()
            n_tokens, shas, backs = [], [], []
            for some in ranges(texts, 1 << 19):
                ids, off = enc(some)
                digits, at = gather(enc.ranks.digits, enc.ranks.digit_offsets, ids)
                back, to = decode(enc.ranks, ids)
                digits, back = digits.tobytes(), back.tobytes()
                for s, e in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
                    n_tokens.append(e - s)
                    shas.append(hashlib.sha256(digits[at[s] : max(at[s], at[e] - 1)]).hexdigest())
                    backs.append(hashlib.sha256(back[to[s] : to[e]]).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(n_tokens, pa.int64()), pa.array(shas, pa.string()), pa.array(backs, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, SCHEMA)


def bpe_encode(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The operator proper: one row a document with its ids (array of int)."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, pattern)
        for b in batches:
            for at, some in enumerate(ranges(b.column(1).fill_null("").to_pylist(), 1 << 19)):
                ids, off = enc(some)
                first = first + len(last) if at else 0
                last = some
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, len(some)).cast(pa.int64()), pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(ids, pa.int32()))], ["doc_id", "ids"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def bpe_decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """The inverse: (doc_id, ids) to (doc_id, text); ids that form no valid UTF-8 decode with replacement marks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = encoder(path, pattern).ranks
        for b in batches:
            ids = b.column(1).fill_null([])
            off = np.concatenate([[0], np.cumsum(ids.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
            back, at = decode(ranks, ids.flatten().to_numpy())
            back = back.tobytes()
            texts = [back[at[s] : at[e]].decode("utf-8", "replace") for s, e in zip(off[:-1], off[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
