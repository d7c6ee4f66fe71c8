"""Removal of every byte under a string of `length` bytes that starts more than once, by a merge sort of suffixes.

Equal strings of 200 bytes choose the same anchor: the leftmost least hash of their 32-byte grams. The windows of one anchor
are neighbours, so its extent, from the first byte of its first window to the last byte of its last one, stands for them all.

1. A scan counts anchors (one 64-bit hash for about 85 bytes of text). Those that occur twice set bits of a bitmap of
   2**BITS bits, which only spares the next step's traffic: a bit set for no reason costs a row.
2. A scan announces the extents of such anchors by a 128-bit BLAKE2b digest, once a task for equal ones. All windows of an
   extent that occurs twice are repeated, wherever it lies. What is left to decide are extents that occur once and share
   their anchor with a different extent.
3. Bytes move for these alone, one suffix an extent, from the anchor to the end of the last window, and the bytes to the
   anchor's left. Tasks sort suffixes and flush them as front-coded runs: the common prefix with the suffix before, then the
   rest. Runs are exchanged by ranges of anchor hashes; a range merges its runs with a loser tree that carries common
   prefixes: of two heads the one sharing more with the last winner is less without a comparison, and equal prefixes are
   compared only behind them, so no known prefix is read again. Two windows that begin `a` bytes before their anchor are
   equal when their suffixes share length - a bytes and the `a` bytes to their left agree; the left bytes are ranked with
   their common prefixes in the same way, read backwards. Every such comparison is one of bytes.

Scale: what moves grows with the number of distinct extents. An anchor with more than `hot` distinct extents does not meet
in one range: its windows go out by blocks of BLOCK starts, to the range that the bytes common to all windows of the block
choose, so equal windows still meet, and are compared in the same way.

Defined cases: a null text is empty; texts below `length` bytes lose nothing by themselves; an empty table gives no rows;
repeated rows are documents that repeat each other, so both lose their bytes; ties (equal suffixes) are what is looked for;
null keys are documents; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from meshwright.llm._text import U64, cut, mix64, only_among, pieces, prefix_hash, release, rows_of, small_batches, span_hash, utf8

GRAM = 32
BITS = 26
BLOCK = 16
HELD = 1 << 19  # extents that a task collapses at once
RUN_BYTES = 16 << 20
OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of x[i : i + width] for every i, by prefix and suffix minima of blocks."""
    n = len(x) - width + 1
    blocks = -(-len(x) // width)
    pad = np.full(blocks * width, np.iinfo(x.dtype).max, x.dtype)
    pad[: len(x)] = x
    grid = pad.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def anchors(data: np.ndarray, off: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(row, place, hash, first window, last window) of every anchor; places count from the start of `data`."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, np.zeros(0, U64), none, none
    h = prefix_hash(data)
    at = np.arange(len(data) - GRAM + 1)
    g = span_hash(h, at, at + GRAM)
    low = sliding_min((g >> U64(24) << U64(24)) | at.astype(U64), length - GRAM + 1)
    place = (low & U64((1 << 24) - 1)).astype(np.int64)
    inside = np.zeros(len(data) + 1, np.int32)
    full = np.diff(off) >= length
    np.add.at(inside, off[:-1][full], 1)
    np.add.at(inside, off[1:][full] - length + 1, -1)
    window = np.flatnonzero(np.cumsum(inside[: len(place)]) > 0)
    if not len(window):
        return none, none, np.zeros(0, U64), none, none
    place = place[window]
    new = np.concatenate([[True], (place[1:] != place[:-1]) | (window[1:] != window[:-1] + 1)])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(window)) - 1
    return np.searchsorted(off, window[first], "right") - 1, place[first], g[place[first]], window[first], window[last]


def _pieces(off: np.ndarray) -> Iterator[tuple[int, int]]:
    return pieces(off, 1 << 20)


def split_long(data: np.ndarray, off: np.ndarray, length: int, limit: int = 1 << 23) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(data, offsets, row numbers, starts in the row) of parts of at most about `limit` bytes: whole rows, or stretches
    of a longer row that overlap by length - 1 bytes, so that each window lies in exactly one."""
    for i, j in _pieces(off):
        if off[j] - off[i] <= limit:
            yield data[off[i] : off[j]], off[i : j + 1] - off[i], np.arange(i, j), np.zeros(j - i, np.int64)
        else:
            for s in range(0, int(off[j] - off[i]) - length + 1, limit - length + 1):
                part = data[off[i] + s : min(off[j], off[i] + s + limit)]
                yield part, np.array([0, len(part)]), np.array([i]), np.array([s])


def _count(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [np.zeros(0, U64)]
            for d, o, _, _ in split_long(*utf8(b.column(0)), length):
                found.append(anchors(d, o, length)[2])
            h, c = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c.astype(np.int64))], ["h", "c"])

    return run


def common_prefix(a: bytes, b: bytes, at: int) -> int:
    """The length of the common prefix of a and b, of which `at` bytes are known."""
    n = min(len(a), len(b))
    if a[at:n] == b[at:n]:
        return n
    while a[at : at + 16] == b[at : at + 16]:
        at += 16
    while a[at] == b[at]:
        at += 1
    return at


_META = np.dtype([("rid", "<i8"), ("place", "<i4"), ("least", "<u2"), ("most", "<u2"), ("lcp", "<u2"), ("alone", "<u2")])


def front_code(entries: list[tuple[bytes, bytes, int, int, int, int]], length: int) -> bytes:
    """A sorted run of (suffix, left bytes, rid, place, least, alone): windows begin least .. len(left) bytes before."""
    meta = np.zeros(len(entries), _META)
    rest, left, before = [], [], b""
    for k, (suffix, lead, rid, place, least, alone) in enumerate(entries):
        lcp = common_prefix(before, suffix, 0)
        meta[k] = (rid, place, least, len(lead), lcp, alone)
        rest.append(suffix[lcp:])
        left.append(lead)
        before = suffix
    return np.array([len(entries)], "<i8").tobytes() + meta.tobytes() + b"".join(rest) + b"".join(left)


def read_run(blob: bytes, length: int) -> tuple[np.ndarray, list[bytes], list[bytes]]:
    n = int(np.frombuffer(blob, "<i8", 1)[0])
    meta = np.frombuffer(blob, _META, n, 8)
    at, suffix, before = 8 + meta.nbytes, [], b""
    for size, lcp in zip((length - meta["least"].astype(int)).tolist(), meta["lcp"].tolist(), strict=True):
        before = before[:lcp] + blob[at : at + size - lcp]
        suffix.append(before)
        at += size - lcp
    left = []
    for size in meta["most"].tolist():
        left.append(blob[at : at + size])
        at += size
    return meta, suffix, left


def merge_runs(runs: list[tuple[list[bytes], list[int]]]) -> Iterator[tuple[int, int, int]]:
    """(run, index, common prefix with the suffix before) of all suffixes in order, by a loser tree over common prefixes.

    runs: sorted suffixes and each one's common prefix with the one before in its run."""
    size = 1 << max(0, (len(runs) - 1).bit_length())
    head: list[bytes | None] = [r[0][0] if r[0] else None for r in runs] + [None] * (size - len(runs))
    lcp, at = [0] * size, [0] * size
    loser = [-1] * size

    def play(i: int, j: int) -> tuple[int, int]:
        """(winner, loser); a loser's lcp is then that with the winner."""
        a, b = head[i], head[j]
        if a is None or b is None:
            return (i, j) if b is None else (j, i)
        if lcp[i] != lcp[j]:
            return (i, j) if lcp[i] > lcp[j] else (j, i)
        n = common_prefix(a, b, lcp[i])
        if n == len(a) if n == len(a) or n == len(b) else a[n] < b[n]:
            if n == len(a) == len(b) and j < i:
                i, j = j, i
            lcp[j] = n
            return i, j
        lcp[i] = n
        return j, i

    winner = list(range(size))
    node = size
    level = winner
    while len(level) > 1:
        node //= 2
        up = []
        for k in range(node):
            w, x = play(level[2 * k], level[2 * k + 1])
            loser[node + k] = x
            up.append(w)
        level = up
    top = level[0]
    while head[top] is not None:
        yield top, at[top], lcp[top]
        at[top] += 1
        suffixes, known = runs[top]
        if at[top] < len(suffixes):
            head[top], lcp[top] = suffixes[at[top]], known[at[top]]
        else:
            head[top] = None
        k = (size + top) // 2
        while k:
            top, loser[k] = play(top, loser[k])
            k //= 2


def left_classes(left: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The order of the strings read backwards, and of each in that order the bytes that it shares with the one before."""
    back = [x[::-1] for x in left]
    order = np.array(sorted(range(len(left)), key=back.__getitem__), np.int64)
    size = np.fromiter(map(len, left), np.int64, len(left))[order]
    wide = max(1, int(size.max(initial=0)))
    grid = np.zeros((len(left), wide), np.uint8)
    inside = np.arange(wide) < size[:, None]
    grid[inside] = np.frombuffer(b"".join([back[k] for k in order.tolist()]), np.uint8)
    differ = (grid[1:] != grid[:-1]) | ~(inside[1:] & inside[:-1])
    shared = np.where(differ.any(1), differ.argmax(1), wide)
    return order, np.concatenate([[0], shared])


def repeated_windows(lcp: np.ndarray, left: list[bytes], least: np.ndarray, length: int) -> np.ndarray:
    """[entry, a]: whether the window that begins a bytes before the anchor has an equal among the other entries.

    Entries are in order of their suffixes; lcp[i] is that with entry i - 1."""
    n, width = len(left), length - GRAM + 1
    out = np.zeros((n, width), bool)
    most = np.fromiter(map(len, left), np.int64, n)
    order, shared = left_classes(left)
    same_left = np.zeros(n, np.int64)
    for a in range(width):
        mine = np.flatnonzero((least <= a) & (a <= most))
        if len(mine) < 2:
            continue
        same_left[order] = np.cumsum(shared < a)
        key = same_left[mine] * (n + 1) + np.cumsum(lcp < length - a)[mine]
        by = np.argsort(key, kind="stable")
        equal = key[by][1:] == key[by][:-1]
        out[mine[by[1:][equal]], a] = True
        out[mine[by[:-1][equal]], a] = True
    return out


def ranges_of(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first, last) of every maximal run of True in the rows of a matrix."""
    edge = np.zeros((mask.shape[0], mask.shape[1] + 1), np.int8)
    edge[:, :-1] += mask
    edge[:, 1:] -= mask
    row, first = np.nonzero(edge == 1)
    _, last = np.nonzero(edge == -1)
    return row, first, last - 1


_SPANS = pa.schema([("rid", pa.int64()), ("first", pa.int32()), ("last", pa.int32())])
_EXTENT = "h long, x long, y long, rid long, place int, least int, most int, n int, others array<struct<rid: long, place: int>>"
_WHERE = pa.struct([("rid", pa.int64()), ("place", pa.int32())])


def _extents(bitmap, length: int):
    """The extents of anchors whose bit is set, equal ones of a task as one row: where one of them lies, how many they are,
    and where the others lie."""

    def table(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        h, x, y, rid, place, least, most = (np.concatenate(c) for c in zip(*parts, strict=True))
        order = np.lexsort((y, x))
        x, y = x[order], y[order]
        new = np.ones(len(x), bool)
        new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
        first = np.flatnonzero(new)
        n = np.diff(np.append(first, len(x)))
        pick, rest = order[first], order[~new]
        others = pa.StructArray.from_arrays([pa.array(rid[rest]), pa.array(place[rest].astype(np.int32))], fields=list(_WHERE))
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n - 1)]).astype(np.int32)), others)
        i32 = lambda v: pa.array(v.astype(np.int32))
        return pa.RecordBatch.from_arrays(
            [pa.array(h[pick].view(np.int64)), pa.array(x[first]), pa.array(y[first]), pa.array(rid[pick]), i32(place[pick]), i32(least[pick]), i32(most[pick]), i32(n), lists],
            [c.split()[0] for c in _EXTENT.split(", ")[:8]] + ["others"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, parts, held = bitmap.value, [], 0
        for b in batches:
            rids = b.column(0).to_numpy()
            for d, o, rows, base in split_long(*utf8(b.column(1)), length):
                r, place, h, first, last = anchors(d, o, length)
                bit = h >> U64(64 - BITS)
                some = np.flatnonzero((words[(bit >> U64(6)).astype(np.int64)] >> (bit & U64(63))) & U64(1))
                if not len(some):
                    continue
                r, place, h, first, last = r[some], place[some], h[some], first[some], last[some]
                raw = memoryview(d.tobytes())
                digest = b"".join([hashlib.blake2b(raw[f:e], digest_size=16).digest() for f, e in zip(first.tolist(), (last + length).tolist(), strict=True)])
                x, y = np.frombuffer(digest, np.int64).reshape(-1, 2).T
                parts.append((h, x, y, rids[rows[r]], place - o[r] + base[r], place - last, place - first))
                held += len(some)
                if held >= HELD:
                    yield table(parts)
                    parts, held = [], 0
        if parts:
            yield table(parts)

    return run


def _ship(length: int, buckets: int):
    """Front-coded runs (bucket, blob) of the extents that a text is asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for bucket, entries in held.items():
                entries.sort()
                yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([front_code(entries, length)], pa.binary())], ["bucket", "blob"])
            held.clear()

        for b in batches:
            asked = b.column(2)
            at = np.concatenate([[0], np.cumsum(asked.value_lengths().to_numpy(zero_copy_only=False))]).tolist()
            each = asked.flatten()
            place, least, most, h, alone, hot = (each.field(k).to_numpy(zero_copy_only=False) for k in range(6))
            bucket = (mix64(h.astype(np.int64).view(U64)) >> U64(16)) % U64(buckets)
            rids = b.column(0).to_pylist()
            for i, raw in enumerate(b.column(1).to_pylist()):
                for k in range(at[i], at[i + 1]):
                    q, lo, hi, to = int(place[k]), int(least[k]), int(most[k]), int(bucket[k])
                    blocks = [(to, lo, hi)]
                    if hot[k]:  # by what all windows of a block share
                        blocks = []
                        for a in range(lo // BLOCK * BLOCK, hi + 1, BLOCK):
                            core = hashlib.blake2b(raw[q - a : q - a - BLOCK + 1 + length], digest_size=8).digest()
                            blocks.append((int.from_bytes(core) % buckets, max(lo, a), min(hi, a + BLOCK - 1)))
                    for to, low, high in blocks:
                        held.setdefault(to, []).append((raw[q : q - low + length], raw[q - high : q], rids[i], q, low, int(alone[k])))
                        size += high - low + length + 300
                if size > RUN_BYTES:
                    yield from flush()
                    size = 0
        yield from flush()

    return run


def _resolve(length: int):
    """The repeated windows of extents that occur once, from the runs of one range."""

    def run(key: tuple, group: pa.Table) -> pa.Table:
        runs = [read_run(x, length) for x in group.column("blob").to_pylist()]
        order = list(merge_runs([(s, m["lcp"].tolist()) for m, s, _ in runs]))
        lcp = np.fromiter((x[2] for x in order), np.int64, len(order))
        # An extent whose gram no other one of the range has: a shared hash.
        paired = lcp >= GRAM
        paired[:-1] |= paired[1:]
        keep = np.flatnonzero(paired)
        if not len(keep):
            return _SPANS.empty_table()
        lcp = np.minimum.reduceat(lcp[: keep[-1] + 1], np.concatenate([[0], keep[:-1] + 1]))  # over those left out
        meta = np.concatenate([runs[order[k][0]][0][order[k][1] : order[k][1] + 1] for k in keep])
        left = [runs[order[k][0]][2][order[k][1]] for k in keep]
        repeated = repeated_windows(lcp, left, meta["least"].astype(np.int64), length)
        repeated &= (meta["alone"] > 0)[:, None]
        row, first, last = ranges_of(repeated)
        return pa.table([pa.array(meta["rid"][row]), pa.array((meta["place"][row] - last).astype(np.int32)), pa.array((meta["place"][row] - first).astype(np.int32))], schema=_SPANS)

    return run


def _bitmap(rows: DataFrame) -> np.ndarray:
    """The bitmap of a table of hashes h, as 2**(BITS - 6) words: what comes to the driver is bounded by that."""
    x = F.expr(f"shiftrightunsigned(h, {64 - BITS})")
    words = rows.groupBy(F.shiftright(x, 6).alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(h, {64 - BITS}) & 63 AS int))")).alias("bits")).toArrow()
    out = np.zeros(1 << (BITS - 6), U64)
    out[words.column(0).to_numpy()] = words.column(1).to_numpy().view(U64)
    return out


def kept_bytes(raw: bytes, firsts: list[int], lasts: list[int], length: int) -> tuple[bytes, int, int]:
    """What is left of a text, how many bytes go, and in how many maximal runs, given ranges of removed windows."""
    if not firsts:
        return raw, 0, 0
    edge = np.zeros(len(raw) + 1, np.int64)
    np.add.at(edge, np.array(firsts), 1)
    np.add.at(edge, np.array(lasts) + length, -1)
    gone = np.cumsum(edge[:-1]) > 0
    spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
    return np.frombuffer(raw, np.uint8)[~gone].tobytes(), int(gone.sum()), spans


def repeated_spans(rows: DataFrame, length: int = 200, hot: int = 1 << 14, per_bucket: int = 40_000) -> DataFrame:
    """(rid, first, last): ranges of starts of repeated windows. rows: (rid, raw)."""
    spark = rows.sparkSession
    counts = rows.select("raw").mapInArrow(_count(length), "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))
    bitmap = spark.sparkContext.broadcast(_bitmap(counts.where("c > 1")))
    release(spark)
    same = Window.partitionBy("x", "y")
    found = rows.mapInArrow(_extents(bitmap, length), _EXTENT).withColumn("c", F.sum("n").over(same)).withColumn("lead", F.min(F.struct("rid", "place")).over(same) == F.struct("rid", "place"))
    found = cut(found.where("lead or c > 1").drop("x", "y", "n"))
    release(spark)
    every = F.concat(F.array(F.struct("rid", "place")), "others")
    sure = found.where("c > 1").select(F.explode(every).alias("o"), "least", "most").selectExpr("o.rid AS rid", "o.place - most AS first", "o.place - least AS last")

    # Anchors with an extent that occurs once and with another one.
    lead = found.where("lead").select("h", "rid", "place", "least", "most", (F.col("c") == 1).alias("alone"))
    mixed = cut(lead.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.max("alone").alias("any")).where("n > 1 AND any").select("h", (F.col("n") > hot).alias("hot"), "n"))
    total = mixed.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    asked = only_among(lead, "h", mixed.select("h")).join(mixed.select("h", "hot"), "h")
    asked = cut(asked.groupBy("rid").agg(F.collect_list(F.struct("place", "least", "most", "h", "alone", "hot")).alias("asked")))
    texts = only_among(rows, "rid", asked.select("rid")).join(asked, "rid").select("rid", "raw", "asked")
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // per_bucket))
    runs = texts.mapInArrow(_ship(length, buckets), "bucket int, blob binary")
    more = cut(runs.groupBy("bucket").applyInArrow(_resolve(length), "rid long, first int, last int"))
    return sure.unionByName(more)


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = 200, hot: int = 1 << 14, per_bucket: int = 40_000) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and what is left as kept_text (binary)."""
    small_batches(docs.sparkSession)
    rows = rows_of(docs, None, doc_id=F.col(key).cast("long"), raw=F.coalesce(F.col(text), F.lit("")).cast("binary")).withColumnRenamed("__rid", "rid")
    spans = repeated_spans(rows.select("rid", "raw"), length, hot, per_bucket)
    by_doc = spans.groupBy("rid").agg(F.collect_list("first").alias("firsts"), F.collect_list("last").alias("lasts"))
    maybe = only_among(rows, "rid", spans.select("rid")).join(by_doc, "rid", "left").select("rid", "doc_id", "raw", "firsts", "lasts")
    none = F.array().cast("array<int>")
    clean = only_among(rows, "rid", spans.select("rid"), without=True).select("rid", "doc_id", "raw", none.alias("firsts"), none.alias("lasts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for raw, firsts, lasts in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True):
                kept, gone, n = kept_bytes(raw, firsts or [], lasts or [], length)
                out.append((len(raw), gone, n, hashlib.sha256(kept).hexdigest(), kept))
            cols = list(zip(*out, strict=True)) or [[]] * 5
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(1), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"])

    schema = f"{OUT}, kept_text binary"
    return maybe.mapInArrow(run, schema).unionByName(clean.mapInArrow(run, schema))
