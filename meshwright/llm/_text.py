"""Vectorised byte-level primitives and small Spark helpers shared by the operators of this subpackage."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwright.functions.iterate import components, cut, delete, fresh, is_scan, numbered, release, shared_folder, small  # noqa: F401 (re-exported)

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = [np.ones(1, U64), np.ones(1, U64)]

#: Bytes that end a word: \x20 and \x09-\x0D.
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit (splitmix64's finaliser)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, b in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, b, U64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=U64)
    return _powers[0], _powers[1]


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """Prefix sums H of a polynomial hash over a sequence of small integers or 64-bit words."""
    n = len(values)
    up, _ = _tables(n + 1)
    out = np.zeros(n + 1, U64)
    np.cumsum((values.astype(U64) + U64(1)) * up[:n], dtype=U64, out=out[1:])
    return out


def span_hash(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans [start, end) under the prefix sums h; equal spans get equal hashes wherever they lie."""
    _, down = _tables(len(h))
    return mix64((h[end] - h[start]) * down[start] + (end - start).astype(U64) * U64(0xD6E8FEB86659FD93))


def utf8(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and the offsets of its rows; a null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    n = len(col)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, where, body = col.buffers()
    off = np.frombuffer(where, np.int64 if wide else np.int32)[col.offset : col.offset + n + 1].astype(np.int64)
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def pieces(off: np.ndarray, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of whole rows with about `limit` bytes each; a longer row is a range of its own."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = j


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of all rows, and how many words lie before each row's start (and at the end)."""
    solid = np.zeros(len(data) + 2, bool)
    solid[1:-1] = ~SPACE[data]
    inner = off[1:-1][(off[1:-1] > 0) & (off[1:-1] < len(data))]
    begins = solid[1:-1] & ~solid[:-2]
    closes = solid[1:-1] & ~solid[2:]
    begins[inner] |= solid[1:-1][inner]
    closes[inner - 1] |= solid[1:-1][inner - 1]
    start = np.flatnonzero(begins)
    return start, np.flatnonzero(closes) + 1, np.searchsorted(start, off)


def gather(flat: np.ndarray, table: np.ndarray, picks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Joins the ragged rows `picks` of (flat, table offsets); returns the joined values and the picks' offsets in them."""
    size = np.diff(table)[picks]
    off = np.zeros(len(picks) + 1, np.int64)
    np.cumsum(size, out=off[1:])
    where = np.arange(off[-1], dtype=np.int64) + np.repeat(table[picks] - off[:-1], size)
    return flat[where], off


def row_sums(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sums of values[off[i]:off[i+1]] for every i; empty ranges give 0."""
    total = np.zeros(len(values) + 1, np.int64 if values.dtype.kind in "biu" else np.float64)
    np.cumsum(values, out=total[1:])
    return total[off[1:]] - total[off[:-1]]


def small_batches(spark: SparkSession, rows: int = 1000, size: int = 8 << 20) -> None:
    """Bounds the rows and bytes of an Arrow batch, so that a Python worker holds a few MB of text at a time. The setting
    stays, because frames that are returned run later; a smaller one of the user's is kept."""
    name = "spark.sql.execution.arrow.max{}PerBatch"
    spark.conf.set(name.format("Records"), str(min(rows, int(spark.conf.get(name.format("Records"))) or rows)))
    now = int(re.sub(r"\D", "", spark.conf.get(name.format("Bytes"))))  # Spark shows it in bytes
    spark.conf.set(name.format("Bytes"), str(min(size, now) if now > 0 else size))


def rows_of(docs: DataFrame, row: str | None, **columns: Column) -> DataFrame:
    """The named columns of docs and __rid, a row's identity: the column `row`, or a number that stays the same in all jobs."""
    wanted = [c.alias(x) for x, c in columns.items()]
    if row is None and not is_scan(docs):
        return numbered(docs.select(*wanted), "__rid").select("__rid", *columns)
    name = row or fresh("__rid", docs.columns)
    told = docs if row else numbered(docs, name)
    return told.select(F.col(f"`{name}`").alias("__rid"), *wanted)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def only_among(rows: DataFrame, column: str, ids: DataFrame, bits: int = 24, without: bool = False) -> DataFrame:
    """Drops rows whose `column` (not null) can't be among `ids` (one column), before any shuffle; or, with
    `without`, exactly the rows that this keeps.

    The ids become a bitmap of 2**bits hashes, broadcast as at most 2**(bits - 15) rows of 4 KB whatever their number. A row
    that slips through by a shared hash must be dropped by the join that follows."""
    place = f"(xxhash64(`{column}`) & {(1 << bits) - 1})"
    word, bit = F.expr(f"shiftright({place}, 15)"), f"cast({place} & 32767 AS int)"
    bitmap = ids.toDF(column).groupBy(word.alias("__word")).agg(F.bitmap_construct_agg(F.expr(f"cast({bit} AS bigint)")).alias("__bits"))
    joined = rows.join(F.broadcast(bitmap), word == F.col("__word"), "left" if without else "inner")
    byte = f"cast(conv(hex(substring(__bits, {bit} div 8 + 1, 1)), 16, 10) AS int)"
    known = F.coalesce(F.expr(f"bit_get({byte}, {bit} % 8) = 1"), F.lit(False))
    return joined.where(~known if without else known).drop("__word", "__bits")
