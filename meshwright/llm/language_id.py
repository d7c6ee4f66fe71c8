"""Language identification by Bayesian evidence fusion.

Evidence for a language l of a document: the likelihood of its text (naive Bayes over hashed byte trigrams, counted over
every row with a usable declared language), the declared markup language d through P(d | l), and a prior P(l | host) that
is smoothed towards P(l | address suffix), which is smoothed towards P(l). P(d | l) and the priors come from grouped sums
of the text's posteriors over all rows; a document's own share is taken out of its host's prior.

Trigrams of a text are not independent, so a text counts as at most `effective` of them. Every language that a row declares
is learned, however rare, with add-0.5 smoothing. The model has `SLOTS` slots for each of at most `max_langs` languages,
which bounds what is broadcast to 8 MB by default; more languages (two or three letters allow 18252) make more models,
each of which scores all texts before the scores are joined by row.

A document is rejected (kept = false) when its text has no trigram, when the best language explains it worse than
uniformly random slots would, or when the fused posterior stays below `confidence`.

Defined cases: a null or too short text gives the language "und" and is rejected; null or malformed declared
languages count as undeclared; a null host or suffix has a group of its own; an empty table gives no rows; repeated rows
and null keys are documents of their own; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshwright.llm._text import U64, cut, mix64, pieces, row_sums, rows_of, small_batches, utf8

SLOTS = 1 << 13
HOT = 200  # a host or declared language with over 1 / HOT of all documents is dealt over several tasks
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER[48:58] = 48
SCORED = "__rid long, doc_id long, declared string, host string, suffix string, fit double, langs array<int>, scores array<double>"


def tag_of(declared: Column) -> Column:
    """The primary subtag of a declared language: "en-US" is en; null if it isn't 2 or 3 letters."""
    return F.nullif(F.regexp_extract(F.lower(F.trim(declared)), r"^([a-z]{2,3})(?:[-_].*)?$", 1), F.lit(""))


def host_of(url: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def suffix_of(host: Column) -> Column:
    return F.nullif(F.regexp_extract(host, r"\.([^.]+)$", 1), F.lit(""))


def trigrams(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The slots of all byte trigrams within rows, and the rows' offsets among them."""
    at = np.zeros(len(off), np.int64)
    size = np.maximum(np.diff(off) - 2, 0)
    np.cumsum(size, out=at[1:])
    if len(data) < 3:
        return np.zeros(0, np.int64), at
    d = _LOWER[data].astype(U64)
    g = (mix64(d[:-2] << U64(16) | d[1:-1] << U64(8) | d[2:]) >> U64(51)).astype(np.int64)
    edge = np.zeros(len(data) + 1, np.int32)
    full = size > 0
    np.add.at(edge, off[:-1][full], 1)
    np.add.at(edge, off[:-1][full] + size[full], -1)
    return g[np.cumsum(edge[: len(data) - 2]) > 0], at


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, np.ndarray] = {}
    for b in batches:
        tags = np.array(b.column(0).to_pylist(), object)
        data, off = utf8(b.column(1))
        for i, j in pieces(off):
            slot, at = trigrams(data[off[i] : off[j]], off[i : j + 1] - off[i])
            name, which = np.unique(tags[i:j].astype(str), return_inverse=True)
            key = np.repeat(which, np.diff(at)) * SLOTS + slot
            sums = np.bincount(key, minlength=len(name) * SLOTS).reshape(-1, SLOTS)
            for k, x in enumerate(name):
                held[x] = held.get(x, 0) + sums[k]
            if len(held) > 512:
                yield from _counted(held)
                held = {}
    yield from _counted(held)


def _counted(held: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    for x, sums in held.items():
        slot = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array([x] * len(slot), pa.string()), pa.array(slot.astype(np.int32)), pa.array(sums[slot].astype(np.int64))], ["lang", "slot", "c"])


class TextModel:
    """names: the languages; table[slot, language]: log P(slot | language) less that of a uniform slot."""

    def __init__(self, names: list[str], counts: np.ndarray):
        self.names = names
        p = (counts + 0.5) / (counts.sum(0, keepdims=True) + 0.5 * SLOTS)
        self.table = (np.log(p) + np.log(SLOTS)).astype(np.float32)


def train(rows: DataFrame, max_langs: int = 256) -> list[TextModel]:
    """Models of all declared languages, at most max_langs each. rows: (tag, text), tag null where nothing usable is declared."""
    told = rows.where("tag is not null")
    names = sorted(r.tag for r in told.select("tag").distinct().collect())
    chunks = [names[k : k + max_langs] for k in range(0, len(names), max_langs)]
    sums = told.select("tag", "text").mapInArrow(_count, "lang string, slot int, c long").groupBy("lang", "slot").agg(F.sum("c").alias("c"))
    sums = cut(sums) if len(chunks) > 1 else sums
    out = []
    for chunk in chunks:
        counts = np.zeros((SLOTS, len(chunk)))
        table = (sums.where(F.col("lang").isin(chunk)) if len(chunks) > 1 else sums).toArrow()
        col = {x: k for k, x in enumerate(chunk)}
        counts[table.column(1).to_numpy(), [col[x] for x in table.column(0).to_pylist()]] = table.column(2).to_numpy()
        out.append(TextModel(chunk, counts))
    return out or [TextModel([], np.zeros((SLOTS, 0)))]


def _score(model, effective: int, before: int = 0, alone: bool = True):
    """Scores by one model, whose languages are numbered from `before`; without `alone` they aren't normalised yet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        n_langs = len(m.names)
        for b in batches:
            data, off = utf8(b.column(5))
            sums, n = [np.zeros((0, n_langs))], [np.zeros(0, np.int64)]
            for i, j in pieces(off, max(1 << 14, (1 << 21) // max(1, n_langs))):
                slot, at = trigrams(data[off[i] : off[j]], off[i : j + 1] - off[i])
                total = np.zeros((len(slot) + 1, n_langs))
                np.cumsum(m.table[slot], axis=0, dtype=np.float64, out=total[1:])
                sums.append(total[at[1:]] - total[at[:-1]])
                n.append(np.diff(at))
            s, n = np.concatenate(sums), np.concatenate(n)
            fit = s.max(1) / np.maximum(n, 1) if n_langs else np.zeros(len(n))
            s = s * (np.minimum(n / 3, effective) / np.maximum(n, 1))[:, None]
            top = s.max(1, keepdims=True) if n_langs else s
            whole = top + np.log(np.exp(s - top).sum(1, keepdims=True)) if n_langs else s
            ok = (s - whole > -30) & (n > 0)[:, None]
            s = s - whole if alone else s
            r, c = np.nonzero(ok)
            where = pa.array(np.concatenate([[0], np.cumsum(ok.sum(1))]).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:5], pa.array(fit), pa.ListArray.from_arrays(where, pa.array((c + before).astype(np.int32))), pa.ListArray.from_arrays(where, pa.array(s[r, c].astype(np.float64)))],
                [x.split()[0] for x in SCORED.split(", ")],
            )

    return run


def _joined(parts: list[DataFrame]) -> DataFrame:
    """The scores of several models as those of one: normalised over all languages, those over 30 below it dropped."""
    rows = parts[0]
    for x in parts[1:]:
        rows = rows.union(x)
    first = [F.first(x).alias(x) for x in ("doc_id", "declared", "host", "suffix")]
    rows = rows.groupBy("__rid").agg(*first, F.max("fit").alias("fit"), F.sort_array(F.flatten(F.collect_list(F.arrays_zip("langs", "scores")))).alias("x"))
    top = F.array_max("x.scores")
    whole = F.col("top") + F.log(F.aggregate("x.scores", F.lit(0.0), lambda a, v: a + F.exp(v - F.col("top"))))
    rows = rows.withColumn("top", top).withColumn("whole", F.when(F.size("x") > 0, whole))
    rows = rows.withColumn("x", F.filter("x", lambda v: v["scores"] - F.col("whole") > -30))
    return rows.select("__rid", "doc_id", "declared", "host", "suffix", "fit", F.col("x.langs").alias("langs"), F.transform("x", lambda v: v["scores"] - F.col("whole")).alias("scores"))


def _looked_up(rows: DataFrame, lines: DataFrame, keys: dict[str, str], heavy: DataFrame, how: str = "inner", parts: int = 16) -> DataFrame:
    """rows joined with lines where the keys, {a row's column: a line's}, are equal; null equals null.

    Rows whose first key is in `heavy` (one column, under HOT values) are dealt over `parts` tasks, their lines go to each."""
    row_key, line_key = next(iter(keys.items()))
    heavy = F.broadcast(heavy.toDF("__hot").withColumn("__heavy", F.lit(True)))  # under HOT rows
    rows = rows.join(heavy, F.col(row_key).eqNullSafe(F.col("__hot")), "left").withColumn("__salt", F.when(F.col("__heavy"), F.pmod(F.xxhash64("__rid"), F.lit(parts))).otherwise(0))
    lines = lines.join(heavy, F.col(line_key).eqNullSafe(F.col("__hot")), "left")
    lines = lines.withColumn("__part", F.explode(F.when(F.col("__heavy"), F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array(F.lit(0)))))
    on = F.col("__salt") == F.col("__part")
    for r, x in keys.items():
        on &= F.col(r).eqNullSafe(F.col(x))
    return rows.drop("__hot", "__heavy").join(lines.drop("__hot", "__heavy"), on, how).drop("__salt", "__part")


def identify(
    docs: DataFrame, key: str = "doc_id", text: str = "text", declared: Column | None = None, host: Column | None = None, suffix: Column | None = None,
    model: list[TextModel] | None = None, confidence: float = 0.5, effective: int = 200, host_weight: float = 20.0, suffix_weight: float = 50.0, declared_weight: float = 20.0,
    row: str | None = None,
) -> DataFrame:
    """One row per document: doc_id, lang, confidence, kept, text_lang, and its identity __rid (the column `row`, where named)."""
    spark = docs.sparkSession
    small_batches(spark)
    null = F.lit(None).cast("string")
    host = null if host is None else host
    rows = rows_of(
        docs, row, doc_id=F.col(key).cast("long"), tag=tag_of(null if declared is None else declared), host=host,
        suffix=suffix_of(host) if suffix is None else suffix, text=F.col(text),
    )
    model = train(rows) if model is None else model
    known = [x for m in model for x in m.names]
    names = F.split(F.lit(",".join(known)), ",")
    wanted, parts, before = rows.select("__rid", "doc_id", "tag", "host", "suffix", "text"), [], 0
    for m in model:
        parts.append(cut(wanted.mapInArrow(_score(spark.sparkContext.broadcast(m), effective, before, len(model) == 1), SCORED)))
        before += len(m.names)
    scored = parts[0] if len(parts) == 1 else cut(_joined(parts))
    long = scored.select("__rid", "declared", "host", "suffix", F.explode(F.arrays_zip("langs", "scores")).alias("x"))
    long = long.select("__rid", "declared", "host", "suffix", F.col("x.langs").alias("l"), F.col("x.scores").cast("double").alias("score")).withColumn("own", F.exp("score"))

    # Rounded sums: the result doesn't depend on the order of addition.
    by_host = cut(long.groupBy("host", "suffix", "declared", "l").agg((F.sum(F.round(F.col("own") * 1e6).cast("long")) / 1e6).alias("n")))
    n_langs = max(1, len(known))
    world = by_host.groupBy("l").agg(F.sum("n").alias("n"))
    total = world.agg(F.sum("n").alias("total"))
    world = world.join(F.broadcast(total), F.lit(True)).select("l", ((F.col("n") + 1) / (F.col("total") + n_langs)).alias("p_world"), F.col("n").alias("n_world"))  # a row a language
    suffixes = by_host.groupBy("suffix", "l").agg(F.sum("n").alias("n_sl"))
    hosts = by_host.groupBy("host", "suffix", "l").agg(F.sum("n").alias("n_hl"))
    in_suffix = by_host.groupBy("suffix").agg(F.sum("n").alias("n_s"))
    in_host = by_host.groupBy("host").agg(F.sum("n").alias("n_h"))
    p_suffix = (F.col("n_sl") + suffix_weight * F.col("p_world")) / (F.col("n_s") + suffix_weight)
    prior = (
        hosts.join(world, "l")
        .join(suffixes.withColumnRenamed("suffix", "s2").withColumnRenamed("l", "l2"), F.col("suffix").eqNullSafe(F.col("s2")) & (F.col("l") == F.col("l2")))
        .join(in_suffix.withColumnRenamed("suffix", "s3"), F.col("suffix").eqNullSafe(F.col("s3")))
        .join(in_host.withColumnRenamed("host", "h2"), F.col("host").eqNullSafe(F.col("h2")))
        .select(F.col("host").alias("ph"), F.col("suffix").alias("ps"), F.col("l").alias("pl"), "n_hl", "n_h", p_suffix.alias("p_suffix"))
    )
    said = by_host.where("declared is not null").groupBy("declared", "l").agg(F.sum("n").alias("n_dl"))
    told = said.groupBy("l").agg(F.sum("n_dl").alias("n_l"))
    at = F.element_at(names, F.col("l") + 1) if known else null
    usual = F.when(F.col("declared") == at, F.lit(0.9)).otherwise(F.lit(0.1 / n_langs))
    said = said.join(told, "l").select(F.col("declared").alias("d2"), F.col("l").alias("dl"), ((F.col("n_dl") + declared_weight * usual) / (F.col("n_l") + declared_weight)).alias("p_said"))

    loo = (F.greatest(F.col("n_hl") - F.col("own"), F.lit(0.0)) + host_weight * F.col("p_suffix")) / (F.greatest(F.col("n_h") - 1, F.lit(0.0)) + host_weight)

    def heavy(column: str) -> DataFrame:
        """Its values that hold over 1 / HOT of all documents each."""
        return by_host.groupBy(column).agg(F.sum("n").alias("n")).join(F.broadcast(total), F.col("n") * HOT > F.col("total")).select(column)  # a row

    fused = _looked_up(long, prior, {"host": "ph", "suffix": "ps", "l": "pl"}, heavy("host"))
    fused = (
        _looked_up(fused, said, {"declared": "d2", "l": "dl"}, heavy("declared"), "left")
        .withColumn("f", F.col("score") + F.log(loo) + F.when(F.col("declared").isNull(), F.lit(0.0)).otherwise(F.log(F.coalesce("p_said", F.lit(0.1 / n_langs)))))
    )
    best = fused.groupBy("__rid").agg(
        F.max_by("l", F.struct("f", -F.col("l"))).alias("l"), F.max("f").alias("top"), F.max_by("l", F.struct("score", -F.col("l"))).alias("tl"), F.collect_list("f").alias("fs")
    )
    weight = F.aggregate("fs", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top")))
    best = best.select("__rid", at.alias("lang"), (1 / weight).alias("confidence"), (F.element_at(names, F.col("tl") + 1) if known else null).alias("text_lang"))
    out = scored.select("__rid", "doc_id", "fit").join(best, "__rid", "left")
    good = (F.col("fit") > 0) & (F.col("confidence") >= confidence)
    return out.select(
        "doc_id",
        F.when(F.col("lang").isNotNull() & (F.col("fit") > 0), F.col("lang")).otherwise("und").alias("lang"),
        F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
        F.coalesce(good, F.lit(False)).alias("kept"),
        "text_lang",
        "__rid",
    )
