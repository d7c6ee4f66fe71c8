"""Near-duplicate classes by ProbMinHash, banding and verification.

A document is its set of five-word shingles (all its words where it has fewer), a shingle weighing 1 + log2 of how often
the document holds it. Each shingle is a Poisson process whose rate is its weight: its arrivals come at exponential steps
and each falls on a random register, which keeps the shingle of its earliest arrival. A shingle stops as soon as its next
arrival comes after the latest register of its document, so long documents need about one arrival a shingle. Two documents
agree in a register with the probability Jaccard similarity of their weights; with unit weights that is the plain Jaccard.
128 registers in 32 bands of 4 find a pair of similarity 0.8 with probability 1 - 5e-8. As a link may be one by its plain
Jaccard alone (a near copy that repeats a passage has other weights), a second signature of unit weights is banded too,
for texts that hold a shingle twice and, in the same buckets, for all others, whose two signatures are one and the same.

Only one row a distinct text is banded. In each bucket every text is verified against the bucket's least one (a star, not
all pairs); links give components. Where a bucket still holds several components, more stars follow, around a text that
differs from bucket to bucket, and then pairs of different components: a pair is formed once, and only if its registers
in a longer signature agree as a link's would (4.1 standard deviations below the threshold's mean are let through), by
weights or by unit weights, and the triangle inequality over that distance to the bucket's least text allows a link. A link is a probability Jaccard or a plain Jaccard of at
least the threshold, computed exactly from the whole texts.

Defined cases: null texts equal the empty text; texts without a word are classes by equality alone; repeated rows and
null keys are documents of their own (of a class, the row with the least key stays, a null key last, then the first row);
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwright.llm._text import U64, components, cut, mix64, only_among, pieces, prefix_hash, release, rows_of, small_batches, span_hash, utf8, words

_STEP = U64(0x9E3779B97F4A7C15)
_SLICE = 1 << 15  # shingles whose arrivals are held at once


def shingles(data: np.ndarray, off: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash, weight) of the distinct shingles of all rows, ascending by row."""
    start, end, at = words(data, off)
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, U64), np.zeros(0)
    h = prefix_hash(span_hash(prefix_hash(data), start, end))
    n = np.diff(at)
    row = np.repeat(np.arange(len(n)), n)
    w = np.arange(len(start))
    short = n[row] < size
    full = np.where(short, w == at[:-1][row], w + size <= at[1:][row])
    w, row = w[full], row[full]
    h = span_hash(h, w, np.where(n[row] < size, at[1:][row], w + size))
    key = h ^ mix64(row.astype(U64) + U64(1))
    order = np.argsort(key)
    new = np.concatenate([[True], key[order][1:] != key[order][:-1]])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(key)))
    pick = order[first]
    back = np.argsort(row[pick], kind="stable")
    pick = pick[back]
    return row[pick], h[pick], 1 + np.log2(count[back])


def prob_min_hash(row: np.ndarray, h: np.ndarray, weight: np.ndarray, n_rows: int, registers: int) -> np.ndarray:
    """[row, register]: the shingle that arrived first; 0 where a row has no shingle."""
    when = np.full(n_rows * registers, np.inf)
    what = np.zeros(n_rows * registers, U64)
    live, x, k, block = np.arange(len(h)), np.zeros(len(h)), 0, 1
    while len(live):
        # A block of arrivals of every live shingle: exponential steps over its rate, and a register each.
        j = np.arange(k + 1, k + 1 + block, dtype=U64)
        for at in range(0, len(live), _SLICE):
            some = live[at : at + _SLICE]
            seed = mix64(h[some][:, None] + j * _STEP)
            u = (seed >> U64(11)).astype(np.float64) * 2.0**-53 + 2.0**-54
            t = x[some][:, None] + np.cumsum(-np.log(u), 1) / weight[some][:, None]
            place = row[some][:, None] * registers + (mix64(seed ^ _STEP) % U64(registers)).astype(np.int64)
            soon = t < when[place]
            t_soon, p_soon, h_soon = t[soon], place[soon], np.broadcast_to(h[some][:, None], t.shape)[soon]
            np.minimum.at(when, p_soon, t_soon)
            won = when[p_soon] == t_soon
            what[p_soon[won]] = h_soon[won]
            x[some] = t[:, -1]
        latest = when.reshape(n_rows, registers).max(1)
        live, k, block = live[x[live] < latest[row[live]]], k + block, 16
    return what.reshape(n_rows, registers)


def band_keys(sig: np.ndarray, bands: int) -> np.ndarray:
    """[row, band]: a hash of the band's number and its registers."""
    rows, registers = sig.shape
    parts = sig.reshape(rows, bands, registers // bands)
    key = np.broadcast_to(mix64(np.arange(1, bands + 1, dtype=U64) * _STEP), (rows, bands))
    for r in range(parts.shape[2]):
        key = mix64(key * U64(3) + parts[:, :, r])
    return key


def planes(sig: np.ndarray, bits: int = 2) -> np.ndarray:
    """[row, bits * registers / 64]: the low bits of every register as bit planes of 64-bit words."""
    part = (sig[:, None, :] >> np.arange(bits, dtype=U64)[None, :, None]) & U64(1)
    return np.packbits(part.astype(np.uint8).reshape(len(sig), -1), axis=1).view(np.int64)


def unit_min_hash(row: np.ndarray, h: np.ndarray, weight: np.ndarray, registers: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows that hold a shingle twice and their signatures of unit weights; any other row's is its signature by weights."""
    again = np.unique(row[weight > 1])
    some = np.isin(row, again)
    return again, prob_min_hash(np.searchsorted(again, row[some]), h[some], np.ones(int(some.sum())), len(again), registers)


def _fine(size: int, registers: int):
    """(rid, planes, unit): longer signatures, of two bits a register, for the few texts whose pairs are to be formed;
    unit, of unit weights, is null where it equals planes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = utf8(b.column(1))
            got, unit = [np.zeros((0, registers // 32), np.int64)], []
            for i, j in ((k, min(k + 128, e)) for a, e in pieces(off, 1 << 17) for k in range(a, e, 128)):  # 2 MB a signature
                row, h, weight = shingles(data[off[i] : off[j]], off[i : j + 1] - off[i], size)
                got.append(planes(prob_min_hash(row, h, weight, j - i, registers)))
                own: list[np.ndarray | None] = [None] * (j - i)
                again, sig = unit_min_hash(row, h, weight, registers)
                for r, x in zip(again, planes(sig) if len(again) else sig, strict=True):
                    own[r] = x
                unit += own
            flat = np.concatenate(got)
            where = pa.array((np.arange(b.num_rows + 1) * flat.shape[1]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(where, pa.array(flat.ravel())), pa.array(unit, pa.list_(pa.int64()))], ["rid", "planes", "unit"])

    return run


def _sign(size: int, registers: int, bands: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = utf8(b.column(3))
            keys, n = [np.zeros(0, U64)], [np.zeros(0, np.int64)]
            for i, j in pieces(off, 1 << 18):
                row, h, weight = shingles(data[off[i] : off[j]], off[i : j + 1] - off[i], size)
                again, sig = unit_min_hash(row, h, weight, registers)
                both, has = np.zeros((j - i, 2, bands), U64), np.zeros((j - i, 2), bool)
                both[:, 0], has[:, 0] = band_keys(prob_min_hash(row, h, weight, j - i, registers), bands), np.bincount(row, minlength=j - i) > 0
                both[again, 1], has[again, 1] = band_keys(sig, bands), True
                keys.append(both[has].ravel())
                n.append(has.sum(1))
            where = np.concatenate([[0], np.cumsum(np.concatenate(n) * bands)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(where), pa.array(np.concatenate(keys).view(np.int64)))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], lists], ["rid", "doc_id", "digest", "keys"])

    return run


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[float, float]:
    """Plain and probability Jaccard of two documents' (shingle hashes, weights)."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(i):
        return 0.0, 0.0
    plain = len(i) / (len(a[0]) + len(b[0]) - len(i))
    x, y = a[1][i], b[1][j]
    order = np.argsort(x / y)
    x, y = x[order], y[order]
    # Of the shared ones, those of a larger ratio count by a's weights and the others by b's; what is in one only counts alone.
    upper = np.cumsum(x[::-1])[::-1] - x + (a[1].sum() - x.sum())
    lower = np.cumsum(y) - y + (b[1].sum() - y.sum())
    return plain, float((1 / (1 + upper / x + lower / y)).sum())


def _verify(size: int, limit: int = 1 << 18):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [utf8(batch.column(c)) for c in (2, 3)]
            got: list[tuple[float, float]] = []
            for i, j in pieces(both[0][1] + both[1][1], limit):  # by the bytes of both sides
                sides = []
                for data, off in both:
                    row, h, weight = shingles(data[off[i] : off[j]], off[i : j + 1] - off[i], size)
                    edge = np.searchsorted(row, np.arange(j - i + 1))
                    sides.append([(h[s:e], weight[s:e]) for s, e in zip(edge[:-1], edge[1:], strict=True)])
                got += [similarity(x, y) for x, y in zip(*sides, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([g[k] for g in got], pa.float64()) for k in (0, 1))], ["a", "b", "plain", "prob"])

    return run


def verified(pairs: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """(a, b, plain, prob) of pairs (a, b) of text numbers. pairs is read several times: it is cut or cheap."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("rid"))
    some = only_among(texts, "rid", ids)
    left = pairs.join(some.withColumnRenamed("rid", "a").withColumnRenamed("text", "ta"), "a")
    both = left.join(some.withColumnRenamed("rid", "b").withColumnRenamed("text", "tb"), "b")
    return cut(both.select("a", "b", "ta", "tb").mapInArrow(_verify(size), "a long, b long, plain double, prob double"), 50_000)


def _still_apart(members: DataFrame, labels: DataFrame) -> DataFrame:
    """The members (bucket, a, plain, prob) of buckets that hold more than one component, with their component la."""
    told = members.join(labels.withColumnRenamed("id", "a"), "a", "left").select("bucket", "a", F.coalesce("label", "a").alias("la"), "plain", "prob")
    mixed = told.groupBy("bucket").agg(F.min("la").alias("lo"), F.max("la").alias("hi")).where("lo <> hi").select("bucket")
    return cut(told.join(mixed, "bucket"), 50_000)


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, threshold: float = 0.8, registers: int = 128, bands: int = 32, fine: int = 2048, row: str | None = None
) -> DataFrame:
    """One row per document: doc_id, class_id, text_id, class_size, kept, and its identity __rid (the column `row`, where named).

    class_id and text_id are the least keys of the near-duplicate class and of the rows with the same text."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = rows_of(docs, row, doc_id=F.col(key).cast("long"), text=F.coalesce(F.col(text), F.lit(""))).withColumnRenamed("__rid", "rid")
    texts = rows.select("rid", "text")
    digest = F.substring(F.unhex(F.sha2("text", 256)), 1, 16)
    signed = cut(rows.select("rid", "doc_id", digest.alias("digest"), "text").mapInArrow(_sign(size, registers, bands), "rid long, doc_id long, digest binary, keys array<long>"))
    release(spark)
    texts_of = cut(signed.select("rid", "digest").groupBy("digest").agg(F.min("rid").alias("cid")))
    banded = only_among(signed.select(F.col("rid").alias("cid"), "keys"), "cid", texts_of.select("cid")).join(texts_of.select("cid"), "cid")
    banded = banded.select("cid", F.explode(F.array_distinct("keys")).alias("bucket"))
    leads = banded.groupBy("bucket").agg(F.min("cid").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    met = cut(banded.join(leads, "bucket").where("cid <> b").select(F.col("cid").alias("a"), "b", "bucket"))

    release(spark)
    star = verified(cut(met.select("a", "b").distinct(), 20_000), texts, size)
    release(spark)
    linked = (F.col("plain") >= threshold) | (F.col("prob") >= threshold)
    labels = components(star.where(linked))
    release(spark)

    # What a bucket still holds apart: first more stars, whose middle differs from bucket to bucket, ...
    members = met.join(star, ["a", "b"]).select("bucket", "a", "plain", "prob")
    apart = _still_apart(members, labels)
    some = apart.where(F.pmod(F.xxhash64("bucket"), F.lit(4)) == 0)  # of 32 buckets a text, 8 are enough here
    middle = some.groupBy("bucket").agg(F.min_by(F.struct("a", "la"), F.xxhash64("bucket", "a")).alias("m"))
    pairs = cut(some.join(middle, "bucket").where("la <> m.la").select(F.least("a", "m.a").alias("a"), F.greatest("a", "m.a").alias("b")).distinct(), 2000)
    if not pairs.isEmpty():
        labels = components(verified(pairs, texts, size).where(linked), labels)
        apart = _still_apart(apart.select("bucket", "a", "plain", "prob"), labels)
        release(spark)

    # ... then pairs, each in the least bucket that it shares, unless their registers or their distances to the bucket's
    # least text rule a link out.
    if not apart.isEmpty():
        far = 1 - threshold + 1e-9
        expect = threshold + (1 - threshold) / 4
        differ = int(fine * (1 - expect) + 4.1 * (fine * expect * (1 - expect)) ** 0.5)
        ids = apart.select("a").distinct()
        info = only_among(texts, "rid", ids).join(ids.withColumnRenamed("a", "rid"), "rid").mapInArrow(_fine(size, fine), "rid long, planes array<long>, unit array<long>")
        info = info.join(only_among(signed.select("rid", "keys"), "rid", ids), "rid").withColumnRenamed("rid", "a")
        left = cut(apart.join(info, "a"))
        right = left.select("bucket", *(F.col(c).alias(f"{c}2") for c in ("a", "la", "plain", "prob", "keys", "planes", "unit")))
        n = fine // 64
        unlike = lambda x, y: " + ".join(f"bit_count(({x}[{w}] ^ {y}[{w}]) | ({x}[{w + n}] ^ {y}[{w + n}]))" for w in range(n))
        # A link may be one by weights or by unit weights: a pair is dropped only where both signatures rule it out.
        alike = f"({unlike('planes', 'planes2')} <= {differ} or ((unit is not null or unit2 is not null) and {unlike('coalesce(unit, planes)', 'coalesce(unit2, planes2)')} <= {differ}))"
        near = (F.abs(F.col("plain") - F.col("plain2")) <= far) | (F.abs(F.col("prob") - F.col("prob2")) <= far)
        pairs = left.join(right, "bucket").where(
            (F.col("a") < F.col("a2")) & (F.col("la") != F.col("la2")) & near & F.expr(alike) & F.expr("array_min(array_intersect(keys, keys2)) = bucket")
        )
        more = verified(cut(pairs.select("a", F.col("a2").alias("b")), 2000), texts, size).where(linked)
        if not more.isEmpty():
            labels = components(more, labels)

    release(spark)
    who = signed.select("rid", "doc_id", "digest").join(texts_of, "digest")
    who = cut(who.join(labels.withColumnRenamed("id", "cid"), "cid", "left").select("rid", "doc_id", "cid", F.coalesce("label", "cid").alias("label")))
    release(spark)
    rank = F.struct(F.col("doc_id").isNull(), "doc_id", "rid")
    classes = who.groupBy("label").agg(F.min(rank).alias("best"), F.count(F.lit(1)).alias("class_size"))
    same = who.groupBy("cid").agg(F.min(rank).alias("first"))
    out = who.join(classes, "label").join(same, "cid")
    return out.select(
        "doc_id", F.col("best.doc_id").alias("class_id"), F.col("first.doc_id").alias("text_id"), "class_size", (F.col("rid") == F.col("best.rid")).alias("kept"), F.col("rid").alias("__rid")
    )
