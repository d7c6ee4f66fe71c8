"""Entity resolution: blocks, neighbours in a sorted block, similarity, components, merged records."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meshwright.functions import profile as p
from meshwright.functions import scalars as s
from meshwright.functions.iterate import components, cut, global_rank

WINDOW = 5


@F.pandas_udf(T.DoubleType())
def ratcliff(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity of the lower-cased texts; no built-in function has it."""
    return pd.Series([difflib.SequenceMatcher(None, (x or "").lower(), (y or "").lower()).ratio() for x, y in zip(a, b, strict=True)])


def block_of(name: Column) -> Column:
    return F.lower(F.substring(s.text_of(name), 1, 1))


def candidate_pairs(df: DataFrame, rid: str, name: str, window: int = WINDOW, similarity: str = "levenshtein", least: float = 0.7) -> DataFrame:
    """(rid_a, rid_b, similarity): each record with the next `window` of its block in name order, above `least`.

    A block may hold any share of the rows: places come from a global rank, and neighbours meet by joining on runs of
    `window` places, so no task sees a whole block."""
    rows = df.select(s.col(rid).alias("rid"), s.text_of(s.col(name)).alias("name")).where(F.col("name").isNotNull())
    ranked = global_rank(rows.withColumn("block", block_of(F.col("name"))), [F.col("block"), F.lower("name"), F.col("rid")], "at")
    left = ranked.withColumn("cell", F.explode(F.expr(f"array(at div {window}, at div {window} + 1)")))
    right = ranked.select(F.expr(f"at div {window}").alias("cell"), *(F.col(c).alias(f"{c}2") for c in ("rid", "name", "block", "at")))
    near = left.join(right, "cell").where((F.col("block") == F.col("block2")) & F.expr(f"at2 > at AND at2 <= at + {window}"))
    score = ratcliff("name", "name2") if similarity == "ratcliff" else s.levenshtein_ratio(F.col("name"), F.col("name2"))
    return near.select(F.col("rid").alias("rid_a"), F.col("rid2").alias("rid_b"), F.round(score, 6).alias("similarity")).where(F.col("similarity") > least)


def clusters(df: DataFrame, pairs: DataFrame, rid: str) -> DataFrame:
    """df with cluster_id: the least rid that a record is linked to; its own where it has no link."""
    label = components(pairs.select(F.col("rid_a").alias("a"), F.col("rid_b").alias("b")))
    return df.join(label.select(F.col("id").alias(rid), "label"), rid, "left").select(*(s.col(c) for c in df.columns), F.coalesce("label", s.col(rid)).alias("cluster_id"))


def merge_clusters(clustered: DataFrame, rid: str, keep: list[str] = ()) -> DataFrame:
    """One record a cluster: numbers average (but for `keep`), others take the first present value by rid."""
    aggs = []
    for f in clustered.schema:
        if f.name in (rid, "cluster_id"):
            continue
        c = s.col(f.name)
        if isinstance(f.dataType, T.NumericType) and f.name not in keep:
            aggs.append(F.avg(c).alias(f.name))
        else:
            aggs.append(F.min_by(c, F.when(c.isNotNull(), s.col(rid))).alias(f.name))
    return clustered.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("records_merged"), *aggs)


def report(clustered: DataFrame) -> DataFrame:
    """(cluster_id, records_merged) of clusters above one record, largest first."""
    sizes = clustered.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("records_merged"))
    return sizes.where("records_merged > 1").orderBy(F.desc("records_merged"), "cluster_id")


def resolve_entities(
    df: DataFrame, name: str, rid: str, threshold: float = 0.75, similarity: str = "ratcliff", max_comparisons: int | None = None, advisor=None, keep: list[str] = ()
) -> tuple[DataFrame, DataFrame]:
    """(merged records, report). All candidate pairs are judged; max_comparisons is a budget for costly advisors."""
    pairs = candidate_pairs(df, rid, name, similarity=similarity)
    if max_comparisons is not None:
        pairs = pairs.orderBy(F.desc("similarity"), "rid_a", "rid_b").limit(max_comparisons)
    pairs = advisor.same_entity(pairs, threshold) if advisor is not None else pairs.where(F.col("similarity") >= threshold)
    told = cut(clusters(df, cut(pairs), rid))
    return merge_clusters(told, rid, keep), report(told)


ENTITY_ENDINGS = ("_title", "_name", "title", "name")  # fixed order


def entity_field(df: DataFrame) -> Column:
    """For each row the name of its entity field: the first column, by ending and then by place, whose text isn't blank; else
    the first text column that isn't; else null."""
    text = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    told = [c for e in ENTITY_ENDINGS for c in text if c.lower().endswith(e)] + text
    picks = [F.when(F.trim(s.col(c)) != "", F.lit(c)) for c in dict.fromkeys(told)]
    return F.coalesce(*picks) if picks else F.lit(None).cast("string")


def key_columns(seen: dict[str, p.ColumnProfile], most: int = 20) -> list[str]:
    """Columns that tell entities apart: text that is seldom null and mostly distinct, names and ids first; else the first
    text column. Only `most` columns are looked at, in their order."""
    some = list(seen.values())[:most]
    good = [c for c in some if c.is_text and c.null_rate < 0.5 and c.present_distinct > 0.5 * c.rows * (1 - c.null_rate)]
    good.sort(key=lambda c: not c.name.lower().endswith((*ENTITY_ENDINGS, "id", "code", "key")))
    return [c.name for c in good] or [c.name for c in some if c.is_text][:1]
