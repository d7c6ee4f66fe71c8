"""Quality rules: word and repetition counts, then n-gram perplexity within language-specific bands.

Model: byte n-grams of order 5 with interpolated modified Kneser-Ney smoothing, one model a language, counted by Spark
over every whole text. A task counts the distinct 5-grams of its texts (exactly, packed in 40 bits) before anything is
shuffled; lower orders count distinct left extensions; discounts come from counts of counts. What a probability is made
of ends in sorted arrays of exact keys (language and 5-gram), so no two n-grams share an entry. The arrays are cut by a
hash of (language, context) into parts of at most PART entries of 36 bytes; a part is broadcast, all texts are scored by
it, and it is dropped. A text's bits are the sum over the parts, so the model may grow with the corpus and memory doesn't.

A document is scored without itself: its own 5-grams are taken out of the counts, the totals and the freed mass of their
contexts. A 5-gram that no other document holds is backed off to a lower order that has lost this one extension, and so
on down; that several such 5-grams of one document meet in one lower context is not taken out.

Bands: the base-2 cross-entropy of every document that passes the base rules goes into an exact histogram of its
language, once a distinct text; the band is the quartiles widened by `width` interquartile ranges on either side, at
least `least` bits. A language with fewer than `few` such texts takes the band of all languages together. Below or above
it, a document is rejected.

Defined cases: a null text has no words; texts below 20 words fail the base; a null language is the language "";
an empty table gives no rows; repeated rows and null keys are documents of their own; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from meshwright.llm._text import U64, cut, mix64, pieces, prefix_hash, release, row_sums, rows_of, small, small_batches, span_hash, utf8, words

ORDER = 5
PART = 1 << 22  # entries of the model that are broadcast at once
BIN = 1024  # bins a bit of cross-entropy
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
STATS = "__rid long, doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, text_hash long, entropy double"


def windows(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All 5-grams that lie within a row, packed in 40 bits, and each row's offset among them."""
    n = len(data)
    if n < ORDER:
        return np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    wide = data.astype(np.int64)
    g = wide[: n - 4] << 32 | wide[1 : n - 3] << 24 | wide[2 : n - 2] << 16 | wide[3 : n - 1] << 8 | wide[4:]
    size = np.maximum(np.diff(off) - (ORDER - 1), 0)
    at = np.zeros(len(off), np.int64)
    np.cumsum(size, out=at[1:])
    whole = np.zeros(n + 1, np.int32)
    full = size > 0
    np.add.at(whole, off[:-1][full], 1)
    np.add.at(whole, off[:-1][full] + size[full], -1)
    return g[np.cumsum(whole[: n - 4]) > 0], at


def _merge_counts(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    gram, count = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(gram, kind="stable")
    gram, count = gram[order], count[order]
    first = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]])) if len(gram) else np.zeros(0, np.int64)
    return gram[first], np.add.reduceat(count, first) if len(first) else count


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram, c): the distinct 5-grams of what the task reads, flushed at 2 M of them."""
    held: dict[str, list] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, parts in held.items():
            gram, count = _merge_counts(parts)
            for at in range(0, len(gram), 100_000):
                g, c = gram[at : at + 100_000], count[at : at + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g), pa.string()), pa.array(g), pa.array(c)], ["lang", "gram", "c"])
        held.clear()

    for b in batches:
        langs = np.array(b.column(0).fill_null("").to_pylist(), object)
        data, off = utf8(b.column(1))
        for i, j in pieces(off):
            g, at = windows(data[off[i] : off[j]], off[i : j + 1] - off[i])
            row_lang = np.repeat(langs[i:j], np.diff(at)) if len(set(langs[i:j])) > 1 else None
            for lang in set(langs[i:j]):
                mine = np.sort(g if row_lang is None else g[row_lang == lang])
                if len(mine):
                    first = np.flatnonzero(np.concatenate([[True], mine[1:] != mine[:-1]]))
                    held.setdefault(lang, []).append((mine[first], np.diff(np.append(first, len(mine)))))
        if sum(len(p[0]) for parts in held.values() for p in parts) > 2_000_000:
            for lang in held:
                held[lang] = [_merge_counts(held[lang])]
            if sum(len(p[0][0]) for p in held.values()) > 2_000_000:
                yield from flush()
    yield from flush()


def count_top(docs: DataFrame, lang: str, text: str) -> DataFrame:
    """(lang, gram, c) of the whole table."""
    rows = docs.select(F.col(lang).alias("lang"), F.col(text).alias("text")).mapInArrow(_count, "lang string, gram long, c long")
    return rows.groupBy("lang", "gram").agg(F.sum("c").alias("c"))


def kneser_ney(top: DataFrame) -> DataFrame:
    """(lang, gram, c, d1, d2, d3, total, freed, q, q_less, p, p_less) of the top order: interpolated modified Kneser-Ney
    probabilities p, what they are made of (q: the lower order's p), and what p and q are without one of the counts."""
    orders = {ORDER: top}
    for k in range(ORDER - 1, 0, -1):  # a lower order counts distinct left extensions
        mask = (1 << 8 * k) - 1
        orders[k] = cut(orders[k + 1].groupBy("lang", F.col("gram").bitwiseAND(mask).alias("gram")).agg(F.count(F.lit(1)).alias("c")), 200_000)
    lower = None
    for k in range(1, ORDER + 1):
        grams = orders[k].withColumn("ctx", F.shiftright("gram", 8))
        of = lambda i: F.sum((F.col("c") == i).cast("long"))
        n = grams.groupBy("lang").agg(*(of(i).alias(f"n{i}") for i in (1, 2, 3, 4)))
        y = F.col("n1") / F.greatest(F.col("n1") + 2 * F.col("n2"), F.lit(1))
        d = lambda i: F.greatest(F.lit(0.0), F.least(F.lit(i - 0.05), F.lit(float(i)) - (i + 1) * F.col("y") * F.col(f"n{i + 1}") / F.greatest(F.col(f"n{i}"), F.lit(1))))
        n = cut(n.withColumn("y", y).select("lang", d(1).alias("d1"), d(2).alias("d2"), d(3).alias("d3")), 200_000)
        less = lambda c: F.when(c <= 0, F.lit(0.0)).when(c == 1, F.col("d1")).when(c == 2, F.col("d2")).otherwise(F.col("d3"))
        grams = grams.join(small(n), "lang").withColumn("less", less(F.col("c")))
        ctx = grams.groupBy("lang", "ctx").agg(F.sum("c").alias("total"), F.sum("less").alias("freed"))
        grams = grams.join(ctx, ["lang", "ctx"])
        if lower is None:
            grams = grams.withColumns({"q": F.lit(1 / 256), "q_less": F.lit(1 / 256)})
        else:
            suffix = lower.select("lang", F.col("gram").alias("suffix"), F.col("p").alias("q"), F.col("p_less").alias("q_less"))
            grams = grams.withColumn("suffix", F.col("gram").bitwiseAND((1 << 8 * (k - 1)) - 1)).join(suffix, ["lang", "suffix"])
        p = (F.col("c") - F.col("less") + F.col("freed") * F.col("q")) / F.col("total")
        one = less(F.col("c") - 1)
        down = F.when(F.col("c") == 1, F.col("q_less")).otherwise(F.col("q"))
        kept = F.greatest(F.col("freed") - F.col("less") + one, F.lit(0.0))
        p_less = F.when(F.col("total") == 1, down).otherwise((F.col("c") - 1 - one + kept * down) / F.greatest(F.col("total") - 1, F.lit(1)))
        lower = cut(grams.select("lang", "gram", "c", "d1", "d2", "d3", "total", "freed", "q", "q_less", p.alias("p"), p_less.alias("p_less")), 200_000)
        release(top.sparkSession)
    return lower


class Model:
    """One part of the model: sorted arrays of one row a (language, 5-gram); key: the language's number before the packed
    5-gram. It holds all 5-grams of a context or none."""

    def __init__(self, part: int, parts: int, names: list[str], discounts: np.ndarray, key: np.ndarray, c: np.ndarray, total: np.ndarray, freed: np.ndarray, q: np.ndarray, q_less: np.ndarray):
        self.part, self.parts = part, parts
        self.names = {x: k for k, x in enumerate(names)}
        self.discounts, self.key = discounts, key
        self.c, self.total, self.freed, self.q, self.q_less = c, total, freed, q, q_less

    def bits(self, g: np.ndarray, at: np.ndarray, lang: np.ndarray) -> np.ndarray:
        """For each row, the bits of its 5-grams g[at[i]:at[i + 1]] in a model without the row's own counts."""
        if not len(g) or not len(self.key):
            return np.zeros(len(at) - 1)
        row = np.repeat(np.arange(len(at) - 1, dtype=np.int64), np.diff(at))
        if self.parts > 1:
            here = part_of(g >> 8, lang[row], self.parts) == self.part
            row, g = row[here], g[here]
            if not len(g):
                return np.zeros(len(at) - 1)
        mine = np.sort(row << 40 | g)
        first = np.flatnonzero(np.concatenate([[True], mine[1:] != mine[:-1]]))
        own = np.diff(np.append(first, len(mine)))
        mine = mine[first]
        row, gram = mine >> 40, mine & ((1 << 40) - 1)
        key = lang[row] << 40 | gram
        i = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        here = self.key[i] == key
        c = np.where(here, self.c[i], own).astype(np.int64)
        d = self.discounts[lang[row]]
        each = np.arange(len(c))
        left = np.maximum(c - own, 0)
        less = d[each, np.minimum(left, 3)]
        ctx = np.flatnonzero(np.concatenate([[True], mine[1:] >> 8 != mine[:-1] >> 8]))
        size = np.diff(np.append(ctx, len(mine)))
        out = np.repeat(np.add.reduceat(own, ctx), size)
        gone = np.repeat(np.add.reduceat(d[each, np.minimum(c, 3)] - less, ctx), size)
        total = self.total[i] - out
        freed = np.maximum(self.freed[i] - gone, 0.0)
        down = np.where(left == 0, self.q_less[i], self.q[i])
        p = np.where(total > 0, (left - less + freed * down) / np.maximum(total, 1), down)
        cost = np.where(here, -own * np.log2(np.clip(p, 2.0**-30, 1.0)), 0.0)
        return np.bincount(row, cost, len(at) - 1)


def part_of(ctx, lang, parts: int):
    """The part of the model that has a context; the same arithmetic on numpy arrays and on columns."""
    return (ctx * 40503 + lang * 7919) % 1000003 % parts


def sorted_arrays(model: DataFrame, limit: int = PART) -> Iterator[Model]:
    """The parts of the model of kneser_ney (cut), one after the other."""
    told = model.groupBy("lang").agg(*(F.first(x).alias(x) for x in ("d1", "d2", "d3"))).orderBy("lang").collect()  # a row a language
    names = [r.lang for r in told]
    number = F.broadcast(model.sparkSession.createDataFrame([(x, k) for k, x in enumerate(names)], "lang string, number long"))
    rows = model.join(number, "lang")
    ctx, parts = F.shiftright("gram", 8), max(1, -(-model.count() // limit))
    while parts > 1 and (rows.groupBy(part_of(ctx, F.col("number"), parts).alias("p")).count().agg(F.max("count")).first()[0]) > limit:
        parts += -(-parts // 4)
    key = F.shiftleft("number", 40).bitwiseOR(F.col("gram")).alias("key")
    f = lambda x: F.col(x).cast("float").alias(x)
    discounts = np.array([[0.0, r.d1, r.d2, r.d3] for r in told]).reshape(-1, 4)
    for k in range(parts):
        some = rows.where(part_of(ctx, F.col("number"), parts) == k) if parts > 1 else rows
        table = some.select(key, "c", "total", f("freed"), f("q"), f("q_less")).toArrow()  # at most `limit` rows
        cols = [table.column(i).to_numpy() for i in range(6)]
        order = np.argsort(cols[0])
        yield Model(k, parts, names, discounts, *(x[order] for x in cols))


def repeated_words(data: np.ndarray, off: np.ndarray, start: np.ndarray, end: np.ndarray, at: np.ndarray, size: int = 8) -> np.ndarray:
    """For each row, its words that lie in a window of `size` words which the row holds twice or more."""
    n = len(start)
    if n < size:
        return np.zeros(len(off) - 1, np.int64)
    word = span_hash(prefix_hash(data), start, end)
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    w = np.arange(n - size + 1)
    w = w[row[w] == row[w + size - 1]]
    h = span_hash(prefix_hash(word), w, w + size) ^ mix64(row[w].astype(U64) + U64(1))
    order = np.argsort(h)
    same = h[order][1:] == h[order][:-1]
    twice = np.zeros(len(w), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, w[twice], 1)
    np.add.at(edge, w[twice] + size, -1)
    return row_sums(np.cumsum(edge[:-1]) > 0, at)


def repeated_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    return len(lines) - len(set(lines))


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for b in batches:
            langs = b.column(2).fill_null("")
            by_row = np.array([m.names.get(x, 0) for x in langs.to_pylist()], np.int64)  # a language without a 5-gram has nothing to score
            data, off = utf8(b.column(3))
            out: list[list[np.ndarray]] = [[] for _ in range(6)]
            for i, j in pieces(off):
                d, o = data[off[i] : off[j]], off[i : j + 1] - off[i]
                start, end, at = words(d, o)
                inside = np.zeros(len(d) + 1, np.int32)
                inside[start] = 1
                np.add.at(inside, end, -1)
                begins = (d & 0xC0) != 0x80
                g, w = windows(d, o)
                bits = m.bits(g, w, by_row[i:j])
                raw = d.tobytes()
                for k, v in enumerate((
                    np.diff(at), row_sums((np.cumsum(inside[:-1]) > 0) & begins, o), row_sums(SYMBOLS[d], o),
                    np.array([repeated_lines(raw[s:e]) for s, e in zip(o[:-1], o[1:], strict=True)], np.int64),
                    repeated_words(d, o, start, end, at), np.where(np.diff(w) > 0, bits / np.maximum(np.diff(w), 1), np.nan),
                )):
                    out[k].append(v)
            cols = [np.concatenate(x) if x else np.zeros(0) for x in out]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), langs, *(pa.array(c.astype(np.int64)) for c in cols[:5]), b.column(4), pa.array(cols[5].astype(np.float64), from_pandas=True)], [x.split()[0] for x in STATS.split(", ")])

    return run


def bands(passed: DataFrame, width: float, least: float, few: int) -> DataFrame:
    """(lang, low, high) in bits, from exact histograms; the row of a null language is that of all together."""
    texts = passed.where("entropy is not null").groupBy("lang", "text_hash").agg(F.min("entropy").alias("entropy"))
    hist = texts.groupBy("lang", F.floor(F.col("entropy") * BIN).alias("bin")).agg(F.count(F.lit(1)).alias("c"))
    hist = hist.unionByName(hist.groupBy("bin").agg(F.sum("c").alias("c")).withColumn("lang", F.lit(None).cast("string")))
    upto = Window.partitionBy("lang").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    hist = hist.withColumn("upto", F.sum("c").over(upto)).withColumn("n", F.sum("c").over(Window.partitionBy("lang")))
    at = lambda q: F.min(F.when(F.col("upto") >= q * F.col("n"), F.col("bin")))
    q = hist.groupBy("lang").agg((at(0.25) / BIN).alias("q1"), ((at(0.75) + 1) / BIN).alias("q3"), F.max("n").alias("n"))
    room = F.greatest(F.lit(least), width * (F.col("q3") - F.col("q1")))
    return q.where((F.col("n") >= few) | F.col("lang").isNull()).select("lang", (F.col("q1") - room).alias("low"), (F.col("q3") + room).alias("high"))


def _more_bits(model):
    """(__rid, bits) of a further part of the model."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for b in batches:
            by_row = np.array([m.names.get(x, 0) for x in b.column(1).fill_null("").to_pylist()], np.int64)
            data, off = utf8(b.column(2))
            bits = [np.zeros(0)]
            for i, j in pieces(off):
                g, w = windows(data[off[i] : off[j]], off[i : j + 1] - off[i])
                bits.append(m.bits(g, w, by_row[i:j]) / np.maximum(np.diff(w), 1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate(bits))], ["__rid", "bits"])

    return run


def scored(rows: DataFrame, model: DataFrame, limit: int = PART) -> DataFrame:
    """STATS of rows (__rid, doc_id, lang, text, text_hash) by a model (cut), part by part."""
    sent, stats, bits = rows.sparkSession.sparkContext.broadcast, None, None
    for part in sorted_arrays(model, limit):
        held = sent(part)
        if stats is None:
            stats = cut(rows.mapInArrow(_score(held), STATS))
        else:
            more = cut(rows.select("__rid", "lang", "text").mapInArrow(_more_bits(held), "__rid long, bits double"))
            bits = more if bits is None else bits.unionByName(more)
        held.destroy()
    if bits is None:
        return stats
    bits = bits.groupBy("__rid").agg(F.sum("bits").alias("bits"))
    return cut(stats.join(bits, "__rid").withColumn("entropy", F.col("entropy") + F.col("bits")).select(*stats.columns))


def quality(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", width: float = 3.0, least: float = 0.0, few: int = 50, limit: int = PART) -> DataFrame:
    """One row per document: the base counts, base_failed, the cross-entropy and perplexity a byte, the band, and kept."""
    spark = docs.sparkSession
    small_batches(spark)
    model = kneser_ney(cut(count_top(docs, lang, text), 200_000))
    rows = rows_of(docs, None, doc_id=F.col(key).cast("long"), lang=F.col(lang), text=F.col(text), text_hash=F.xxhash64(F.col(text)))
    stats = scored(rows, model, limit).withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))
    edge = cut(bands(stats.where("not base_failed"), width, least, few))
    own = edge.where("lang is not null")
    every = edge.where("lang is null").select(F.col("low").alias("all_low"), F.col("high").alias("all_high"))
    joined = stats.join(small(own), "lang", "left").join(F.broadcast(every), F.lit(True), "left")  # one row
    low, high = F.coalesce("low", "all_low"), F.coalesce("high", "all_high")
    return joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & F.coalesce(F.col("entropy").between(low, high), F.lit(True))).alias("kept"),
        "entropy", F.pow(F.lit(2.0), "entropy").alias("perplexity"), low.alias("low"), high.alias("high"), "lang",
    )
