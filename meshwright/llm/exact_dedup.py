"""Exact deduplication over a log-structured merge index of text digests.

Write path: a task puts (digest, identifier, count) into a memtable, so copies within a task meet at once. A full
memtable flushes as a sorted run, and the task's own runs are compacted before anything leaves it.
Compaction proper: runs are split at digest prefixes. A prefix range adds its runs to a counting Bloom filter, drops
what the filter proves to be in one run only, and merges the rest, keeping one identifier a digest: the smallest
(keep="min") or the largest (keep="max") pair of key and row number.
Hits: digests that occur more than once. The rows of hits are grouped by their bytes, each task combining its copies before
anything is shuffled; a digest with two texts (a collision) takes its groups from there instead of from the index.

A hot text costs each task one entry in the index and one text in the verification, whatever its copies. A bitmap of fixed
size (2**24 bits, broadcast) keeps the rows of no hit out of both shuffles; the more of its bits are set, the less it saves.
Verdicts reach rows by the digest: groups above a 10,000th of all rows (so 10,000 of them at most) are broadcast, and
what is left has no key with more rows than that.

Defined cases: a null text equals the empty text; a null key counts as the smallest identifier under keep="max" and
as the largest under keep="min", as does the key that is the least or largest long itself; rows that repeat with key and text
are still rows of their own and one of them stays; an empty table gives no rows; other input columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from meshwright.llm._text import cut, only_among, rows_of, small, small_batches

_PER_KEY = 8
_RUN = "bucket int, digests binary, keys binary, rids binary, counts binary"
_ENTRY = np.dtype([("d", ">u8"), ("e", ">u8")])


class Memtable:
    """Entries (digest, best key, row number, count); flushes itself as a sorted run when it is full."""

    def __init__(self, capacity: int):
        self.capacity, self.rows, self.size, self.runs = capacity, [], 0, []

    def put(self, digest: np.ndarray, key: np.ndarray, rid: np.ndarray, count: np.ndarray) -> None:
        self.rows.append((digest, key, rid, count))
        self.size += len(digest)
        if self.size >= self.capacity:
            self.flush()

    def flush(self) -> None:
        if self.rows:
            self.runs.append(merge_runs(self.rows))
            self.rows, self.size = [], 0
        # Tiered compaction: merge while the newest run has reached half its elder.
        while len(self.runs) > 1 and 2 * len(self.runs[-1][0]) >= len(self.runs[-2][0]):
            self.runs[-2:] = [merge_runs(self.runs[-2:])]


def merge_runs(runs: list[tuple]) -> tuple:
    """One sorted run: a digest's largest (key, row number) and the sum of its counts."""
    digest, key, rid, count = (np.concatenate(x) for x in zip(*runs, strict=True))
    order = np.lexsort((rid, key, digest["e"], digest["d"]))
    digest, key, rid, count = digest[order], key[order], rid[order], count[order]
    last = np.ones(len(digest), bool)
    last[:-1] = digest[1:] != digest[:-1]
    total = np.cumsum(count)[last]
    return digest[last], key[last], rid[last], np.diff(total, prepend=0)


def add_to_filter(table: np.ndarray, digest: np.ndarray) -> None:
    """Counts a run's (distinct) digests into a filter: two probes each, over a power of two of counters that stop at 2."""
    for part, half in zip(("d", "e"), np.split(table, 2), strict=True):
        seen = np.bincount(digest[part].astype(np.uint64).astype(np.int64) & (len(half) - 1), minlength=len(half))
        np.minimum(half + seen, 2, out=half, casting="unsafe")


def in_two_runs(table: np.ndarray, digest: np.ndarray) -> np.ndarray:
    """False where the filter proves that no second run has the digest."""
    low, high = np.split(table, 2)
    ask = [half[digest[part].astype(np.uint64).astype(np.int64) & (len(half) - 1)] > 1 for part, half in (("d", low), ("e", high))]
    return ask[0] & ask[1]


def _flush_runs(capacity: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Memtable(capacity)
        for b in batches:
            if b.num_rows:
                digest = np.frombuffer(b"".join(b.column(0).to_pylist()), _ENTRY)
                table.put(digest, b.column(1).to_numpy(), b.column(2).to_numpy(), np.ones(b.num_rows, np.int64))
        table.flush()
        for digest, key, rid, count in [merge_runs(table.runs)] if table.runs else []:
            bucket = (digest["d"].astype(np.uint64) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
            for k in np.unique(bucket):
                at = slice(*np.searchsorted(bucket, [k, k + np.uint64(1)]))
                row = [[int(k)], [digest[at].tobytes()], [key[at].tobytes()], [rid[at].tobytes()], [count[at].tobytes()]]
                yield pa.RecordBatch.from_arrays([pa.array(row[0], pa.int32()), *(pa.array(x, pa.binary()) for x in row[1:])], _RUN_NAMES)

    return run


_RUN_NAMES = [x.split()[0] for x in _RUN.split(", ")]


def _compact(group: pa.Table) -> pa.Table:
    """Merges the runs of a digest range into its hits. A digest of one run only and of count 1 is none, and skips the merge."""
    runs = [(np.frombuffer(r["digests"], _ENTRY), *(np.frombuffer(r[k], np.int64) for k in ("keys", "rids", "counts"))) for r in group.to_pylist()]
    table = np.zeros(2 << max(6, (sum(len(r[0]) for r in runs) * _PER_KEY - 1).bit_length()), np.uint8)
    for r in runs:
        add_to_filter(table, r[0])
    met = [in_two_runs(table, r[0]) | (r[3] > 1) for r in runs]
    digest, best, rid, count = merge_runs([tuple(x[m] for x in r) for r, m in zip(runs, met, strict=True)])
    hit = count > 1
    return pa.table(
        {
            "digest": pa.array([digest[i].tobytes() for i in np.flatnonzero(hit)], pa.binary()),
            "keep": pa.array(best[hit]),
            "keep_rid": pa.array(rid[hit]),
            "group_size": pa.array(count[hit]),
        }
    )


def exact_dedup(
    docs: DataFrame, key: str = "doc_id", text: str = "text", keep: str = "max", capacity: int = 1 << 16, rows_per_bucket: int = 1 << 19, digest_bytes: int = 16, row: str | None = None
) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256 (lowercase hex), and its identity __rid (the column `row`, where named).

    digest_bytes < 16 weakens the index's digest (for tests of the byte verification).
    """
    spark = docs.sparkSession
    small_batches(spark, 10_000)
    sign = 1 if keep == "max" else -1
    null = -(1 << 63) if keep == "max" else (1 << 63) - 1
    kind = dict(docs.select(F.col(key).alias("k")).dtypes)["k"]
    rows = rows_of(docs, row, doc_id=F.col(key), text=F.coalesce(F.col(text), F.lit("")))
    rows = rows.withColumn("text_sha256", F.sha2("text", 256))
    digest = F.unhex(F.concat(F.substring("text_sha256", 1, 2 * digest_bytes), F.lit("0" * (32 - 2 * digest_bytes))))
    order_key = F.coalesce(F.col("doc_id").cast("long"), F.lit(null))
    rows = rows.withColumns({"digest": digest, "key": order_key if sign > 0 else -order_key - 1, "rank": F.col("__rid") * sign})

    total = docs.count()
    buckets = max(1, -(-total // rows_per_bucket), min(int(spark.conf.get("spark.sql.shuffle.partitions")), total // 4096))
    runs = rows.select("digest", "key", "rank").mapInArrow(_flush_runs(capacity, buckets), _RUN)
    hits = cut(runs.groupBy("bucket").applyInArrow(_compact, "digest binary, keep long, keep_rid long, group_size long"))

    # Byte verification of the hits' rows.
    maybe = only_among(rows, "digest", hits.select("digest"))
    texts = maybe.groupBy("digest", "text_sha256", "text").agg(F.max(F.struct("key", "rank")).alias("best"), F.count(F.lit(1)).alias("group_size"))
    texts = texts.join(hits.select("digest"), "digest", "left_semi").select("digest", "text_sha256", F.col("best.key").alias("keep"), F.col("best.rank").alias("keep_rid"), "group_size")
    collided = cut(texts.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("digest"))).where("n > 1").drop("n"))
    narrow = maybe.select("__rid", "doc_id", "text_sha256", "digest")
    alone = only_among(rows, "digest", hits.select("digest"), without=True).select("__rid", "doc_id", "text_sha256")
    verdicts = []
    if not collided.isEmpty():
        verdicts.append(narrow.join(collided.drop("digest"), "text_sha256"))
        hits = hits.join(collided.select("digest"), "digest", "left_anti")
        narrow = narrow.join(small(collided.select("digest").distinct()), "digest", "left_anti")
    large = F.col("group_size") > max(1, total // 10_000)
    verdicts.append(narrow.join(F.broadcast(hits.where(large)), "digest"))
    rest = narrow.join(F.broadcast(hits.where(large).select("digest")), "digest", "left_anti")
    verdicts.append(rest.join(hits.where(~large), "digest", "left"))
    none = {"keep": F.lit(None).cast("long"), "keep_rid": F.lit(None).cast("long"), "group_size": F.lit(None).cast("long")}
    out = alone.withColumns(none)
    for v in verdicts:
        out = out.unionByName(v.select(*out.columns))
    keep_key = F.col("keep") if sign > 0 else -F.col("keep") - 1
    return out.select(
        "doc_id",
        F.when(F.col("keep").isNull(), F.col("doc_id")).when(keep_key != null, keep_key.cast(kind)).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("keep_rid") * sign == F.col("__rid"), F.lit(True)).alias("kept"),
        "text_sha256",
        "__rid",
    )
