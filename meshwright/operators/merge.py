"""Merging sources: first-row dedup, guarded inner chain, full-outer chain, universal merge.

Duplicates go before a join, by an aggregation that combines within tasks first, so both sides of every join have unique
keys: no join multiplies rows, and a hot key costs each task one row."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshwright.functions import scalars as s
from meshwright.functions.iterate import cut
from meshwright.operators.align import union_unified



@dataclass(frozen=True)
class MergePolicy:
    join_keys: list[str]
    canonical: list[str] = field(default_factory=list)
    strong_keys: list[str] = field(default_factory=list)
    min_keys: int = 2
    max_blowup: float = 1.8
    guard: bool = True


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row a key, the first by `order` (ascending expressions, nulls first; they must settle ties); null keys are equal."""
    rest = [c for c in df.columns if c not in keys]
    first = F.min_by(F.struct(*(s.col(c) for c in rest)), F.struct(*(o.alias(f"o{i}") for i, o in enumerate(order)))) if rest else F.count(F.lit(1))
    out = df.groupBy(*(s.col(k) for k in keys)).agg(first.alias("__row"))
    return out.select(*(s.col(c) if c in keys else F.col("__row").getField(c).alias(c) for c in df.columns))


def join_columns(left: list[str], right: list[str], policy: MergePolicy) -> list[str]:
    """Join keys that both have, else the first two canonical columns that both have."""
    shared = set(left) & set(right)
    return [k for k in policy.join_keys if k in shared] or [c for c in policy.canonical if c in shared][:2]


def strong_enough(keys: list[str], policy: MergePolicy) -> bool:
    return len(keys) >= policy.min_keys and (not policy.strong_keys or any(k in policy.strong_keys for k in keys))


def group_means(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """(left_rows, right_rows, left_mean, right_mean, estimate): mean rows a key of both sides and their product."""

    def side(df: DataFrame, name: str) -> DataFrame:
        sizes = df.groupBy(*(s.col(k) for k in keys)).agg(F.count(F.lit(1)).alias("n"))
        return sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias(f"{name}_rows"), F.avg("n").alias(f"{name}_mean"))

    both = side(left, "left").crossJoin(side(right, "right"))  # a single row each
    return both.select("left_rows", "right_rows", "left_mean", "right_mean", (F.col("left_mean") * F.col("right_mean")).alias("estimate"))


def safe_blowup(left: DataFrame, right: DataFrame, keys: list[str], ratio: float) -> bool:
    """Whether the product of mean group sizes stays within `ratio` times the larger side; an empty side doesn't."""
    r = group_means(left, right, keys).first()
    return bool(keys) and r.estimate is not None and r.estimate <= ratio * max(r.left_rows, r.right_rows)


def merge_pair(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Equi-join on keys; a column of both is the right side's value as the left's type, or else the left's."""
    kinds = {f.name: f.dataType for f in left.schema}
    other = {f.name: f.dataType for f in right.schema}
    for k in keys:
        if kinds[k] != other[k]:
            left, right = (df.withColumn(k, s.text_of(s.col(k))) for df in (left, right))
    shared = [c for c in right.columns if c in left.columns and c not in keys]
    moved = right.select(*(s.col(c).alias(f"__r_{c}") if c in shared else s.col(c) for c in right.columns))
    joined = left.join(moved, keys, how)
    out = [F.coalesce(s.col(f"__r_{c}").try_cast(kinds[c]), s.col(c)).alias(c) if c in shared else s.col(c) for c in left.columns]
    return joined.select(*out, *(s.col(c) for c in right.columns if c not in left.columns))


def safe_inner_chain(frames: list[DataFrame], policy: MergePolicy, orders: list[list[Column]]) -> tuple[DataFrame, list[dict]]:
    """Inner joins from the base through every frame whose keys are strong enough and don't blow up; with a log."""
    base = base_index(frames, policy)
    out, order, log = frames[base], orders[base], []
    for i, f in enumerate(frames):
        if i == base:
            continue
        keys = join_columns(out.columns, f.columns, policy)
        if not strong_enough(keys, policy) or (policy.guard and not safe_blowup(out, f, keys, policy.max_blowup)):
            log.append({"frame": i, "keys": keys, "joined": False})
            continue
        if order is not None:
            out, order = keep_first(out, keys, order), None
        else:
            out = keep_first(out, keys, [s.col(c) for c in out.columns])
        out = merge_pair(out, keep_first(f, keys, orders[i]), keys, "inner")
        log.append({"frame": i, "keys": keys, "joined": True})
        if any(k != base for k in range(i + 1, len(frames))):  # the next frame's guard and join start from here
            out = cut(out)
    return out, log


def base_index(frames: list[DataFrame], policy: MergePolicy) -> int:
    """The frame with the most join keys, then the widest, then the last."""
    return max(range(len(frames)), key=lambda i: (sum(k in frames[i].columns for k in policy.join_keys), len(frames[i].columns), i))


def universal_merge(frames: list[DataFrame], policy: MergePolicy, orders: list[list[Column]]) -> tuple[DataFrame, dict]:
    """Full-outer joins of all frames with keys, from the base on; what has no key or can't be joined is appended."""
    keyed = [i for i, f in enumerate(frames) if any(k in f.columns for k in policy.join_keys)]
    appended = [i for i in range(len(frames)) if i not in keyed]
    joined, out = [], None
    if keyed:
        base = keyed[base_index([frames[i] for i in keyed], policy)]
        out, order, joined = frames[base], orders[base], [base]
        for i in keyed:
            if i == base:
                continue
            keys = [k for k in policy.join_keys if k in out.columns and k in frames[i].columns]
            if not keys or (policy.guard and not safe_blowup(out, frames[i], keys, policy.max_blowup)):
                appended.append(i)
                continue
            out = keep_first(out, keys, order if order is not None else [s.col(c) for c in out.columns])
            order = None
            out = merge_pair(out, keep_first(frames[i], keys, orders[i]), keys, "full")
            joined.append(i)
            if i != keyed[-1]:
                out = cut(out)
    parts = ([out] if out is not None else []) + [frames[i] for i in sorted(appended)]
    result = parts[0] if len(parts) == 1 else union_unified(parts)
    return result, {"with_keys": len(keyed), "without_keys": len(frames) - len(keyed), "outer_join_chain": joined, "appended": sorted(appended)}
