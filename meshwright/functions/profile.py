"""Column profiles: everything that per-column decisions need, from one aggregation over all columns."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meshwright.functions import scalars as s

PUNCTUATION = "[^0-9A-Za-z\\u4e00-\\u9fa5 ]"
#: Shares of distinct values that column decisions compare with, and how near to one a sketch is counted over: five
#: standard errors of a sketch of 2**SKETCH registers. Up to FEW values are always counted. Such a sketch is one binary
#: value; approx_count_distinct keeps each word of its registers as a column of the aggregation.
SHARES, MARGIN, SKETCH, FEW = (0.01, 0.02, 0.2, 0.3, 0.5, 0.8, 0.95), 0.05, 14, 64


@dataclass(frozen=True)
class ColumnProfile:
    name: str
    dtype: T.DataType
    rows: int
    nulls: int
    distinct: int  # a null counts as a value
    numeric: float  # share of rows that are decimal literals, commas dropped
    usable: float
    padded: int  # values with outer white space
    unnumbered: int  # present values that are no number
    lowered: int  # distinct values when lower-cased
    booleans: int  # present values outside the truth vocabulary
    present_distinct: int
    punctuation: float

    @property
    def null_rate(self) -> float:
        return self.nulls / max(1, self.rows)

    @property
    def unique_rate(self) -> float:
        return self.distinct / max(1, self.rows)

    @property
    def is_numeric(self) -> bool:
        return isinstance(self.dtype, T.NumericType)

    @property
    def is_text(self) -> bool:
        return isinstance(self.dtype, T.StringType)


def _measures(name: str, approximate: bool) -> list:
    c = s.col(name)
    t = s.text_of(c)
    distinct = (lambda x: F.hll_sketch_estimate(F.hll_sketch_agg(x, F.lit(SKETCH)))) if approximate else F.count_distinct
    flag = lambda x: F.coalesce(F.sum(F.coalesce(x, F.lit(False)).cast("int")), F.lit(0))
    return [
        flag(c.isNull()), distinct(t) + F.coalesce(F.max(c.isNull().cast("int")), F.lit(0)),
        F.coalesce(F.avg(s.looks_numeric(c).cast("int")), F.lit(0.0)), F.coalesce(F.avg(s.is_usable(c).cast("int")), F.lit(0.0)),
        flag(t != s.strip(c)), flag(c.isNotNull() & (s.strip(c) != "") & s.to_number(c).isNull()), distinct(F.lower(t)),
        flag(c.isNotNull() & s.to_bool(c).isNull()), distinct(t),
        F.coalesce(F.sum(F.regexp_count(t, F.lit(PUNCTUATION))), F.lit(0)) / F.greatest(F.coalesce(F.sum(F.length(t)), F.lit(0)), F.lit(1)),
    ]


def _at_issue(distinct: int, of: int) -> bool:
    return any(abs(distinct - share * of) <= MARGIN * share * of for share in SHARES)


def profile(df: DataFrame, columns: list[str] | None = None, approximate: bool | None = None) -> dict[str, ColumnProfile]:
    """One job for all columns, with sketches of distinct values. Unless `approximate`, a second one counts exactly where a
    decision could turn on it: columns of few values by their set, which the sketch bounds, and columns near a share by a
    distinct count. approximate=False counts all exactly, which expands the rows twice a column."""
    names = columns if columns is not None else df.columns
    if not names:
        return {}
    packed = [F.struct(*(m.alias(f"m{i}") for i, m in enumerate(_measures(n, approximate is not False)))).alias(f"p{k}") for k, n in enumerate(names)]
    row = df.agg(F.count(F.lit(1)).alias("rows"), *packed).first()
    seen = {n: ColumnProfile(n, df.schema[n].dataType, row["rows"], *row[f"p{k}"]) for k, n in enumerate(names)}
    if approximate is False:
        return seen
    seen = {n: replace(c, distinct=min(c.distinct, c.rows), present_distinct=min(c.present_distinct, c.rows - c.nulls)) for n, c in seen.items()}
    return seen if approximate else _counted(df, seen)


def _counted(df: DataFrame, seen: dict[str, ColumnProfile]) -> dict[str, ColumnProfile]:
    few = [n for n, c in seen.items() if c.present_distinct <= FEW]
    near = [n for n, c in seen.items() if c.present_distinct > FEW and (_at_issue(c.distinct, c.rows) or _at_issue(c.present_distinct, c.rows - c.nulls))]
    size = lambda x: F.size(F.collect_set(x))
    counts = [*(size(s.text_of(s.col(n))) for n in few), *(size(F.lower(s.text_of(s.col(n)))) for n in few), *(F.count_distinct(s.text_of(s.col(n))) for n in near)]
    if not counts:
        return seen
    got = list(df.agg(*(c.alias(f"n{i}") for i, c in enumerate(counts))).first())
    told = {n: (k, low) for n, k, low in zip(few, got, got[len(few) :], strict=False)} | {n: (k, seen[n].lowered) for n, k in zip(near, got[2 * len(few) :], strict=True)}
    return {n: replace(c, distinct=told[n][0] + (c.nulls > 0), present_distinct=told[n][0], lowered=told[n][1]) if n in told else c for n, c in seen.items()}


def column_quality(df: DataFrame) -> DataFrame:
    """(column_name, null_count, null_rate, n_unique, unique_rate): long form of one aggregation, rates at 4 decimals."""
    rows = F.count(F.lit(1))
    stats = []
    for n in df.columns:
        c = s.col(n)
        nulls = F.sum(c.isNull().cast("long"))
        unique = F.count_distinct(c) + F.max(c.isNull().cast("long"))
        stats.append(
            F.struct(F.lit(n).alias("column_name"), nulls.alias("null_count"), F.round(nulls / rows, 4).alias("null_rate"), unique.alias("n_unique"), F.round(unique / rows, 4).alias("unique_rate"))
        )
    return df.agg(F.array(*stats).alias("q")).select(F.inline("q"))


def sigma_share(df: DataFrame, columns: list[str], k: float = 3.0) -> DataFrame:
    """(column_name, present, outliers, score): share of present values within k sample deviations of the mean.

    Two scans; the first one's result is a single row. A column without spread scores 1."""
    stats = df.agg(*(f(s.col(n)).alias(f"{a}{i}") for i, n in enumerate(columns) for a, f in (("m", F.avg), ("d", F.stddev_samp))))
    rows = df.select(*(s.col(n).alias(f"c{i}") for i, n in enumerate(columns))).crossJoin(F.broadcast(stats))  # a single row
    out = []
    for i, n in enumerate(columns):
        c, d = F.col(f"c{i}"), F.col(f"d{i}")
        far = F.coalesce(F.sum((F.abs(c - F.col(f"m{i}")) > k * d).cast("long")), F.lit(0))
        far = F.when(F.coalesce(F.max(d), F.lit(0.0)) > 0, far).otherwise(F.lit(0))
        out.append(F.struct(F.lit(n).alias("column_name"), F.count(c).alias("present"), far.alias("outliers"), F.round(1 - far / F.greatest(F.count(c), F.lit(1)), 6).alias("score")))
    return rows.agg(F.array(*out).alias("q")).select(F.inline("q"))


def quartiles(df: DataFrame, column: str, approximate: bool = False) -> DataFrame:
    """(q25, q75) by nearest rank. Exact quantiles count values first, so that ties and hot values shrink before any
    ordering; the ranks come from a global rank over distinct values rather than from one task."""
    c = s.col(column).cast("double")
    if approximate:
        return df.agg(F.percentile_approx(c, 0.25, 100_000).alias("q25"), F.percentile_approx(c, 0.75, 100_000).alias("q75"))
    # Exact percentiles keep a value -> count map, not the rows; nearest rank has no interpolation.
    values = df.where(c.isNotNull()).groupBy(c.alias("v")).agg(F.count(F.lit(1)).alias("n"))
    from meshwright.functions.iterate import global_rank
    from pyspark.sql.window import Window

    ranked = global_rank(values, [F.col("v")], "at").withColumn("part", F.expr("at div 1024"))
    sums = ranked.groupBy("part").agg(F.sum("n").alias("s"))
    before = sums.select("part", F.coalesce(F.sum("s").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    upto = F.col("before") + F.sum("n").over(Window.partitionBy("part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    total = sums.agg(F.sum("s").alias("total"))
    placed = ranked.join(before, "part").withColumn("upto", upto).crossJoin(F.broadcast(total))  # a single row
    at = lambda q: F.min(F.when(F.col("upto") > F.round(q * (F.col("total") - 1)), F.col("v")))
    return placed.agg(at(0.25).alias("q25"), at(0.75).alias("q75"))


def iqr_bounds(df: DataFrame, column: str, k: float = 1.5, approximate: bool = False) -> DataFrame:
    spread = F.col("q75") - F.col("q25")
    return quartiles(df, column, approximate).select("q25", "q75", (F.col("q25") - k * spread).alias("low"), (F.col("q75") + k * spread).alias("high"))


def value_frequency(df: DataFrame, column: str, top: int | None = None) -> DataFrame:
    """(value, n), most frequent first, ties by value; blank values don't count. `top` is a top-k report."""
    v = s.text_of(s.col(column))
    out = df.where(~s.is_missing(s.col(column))).groupBy(v.alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value")
    return out if top is None else out.limit(top)


def dictionary_budget(distinct: int, share: float = 0.005, least: int = 50) -> int:
    return max(least, int(distinct * share))


def title_column(profiles: dict[str, ColumnProfile]) -> str | None:
    """The text column with the largest share of distinct present values."""
    text = [p for p in profiles.values() if p.is_text]
    return max(text, key=lambda p: p.present_distinct / max(1, p.rows)).name if text else None
