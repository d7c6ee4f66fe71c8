"""Lenient readers and sinks for a folder of heterogeneous files."""

from __future__ import annotations

import glob
import json
import re
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meshwright.functions import scalars as s

ROOTS = ("datas", "datalake", "data")
ROW = "_rid"


def expand_braces(pattern: str) -> list[str]:
    m = re.search(r"\{([^{}]*)\}", pattern)
    if not m:
        return [pattern]
    return [x for part in m[1].split(",") for x in expand_braces(pattern[: m.start()] + part + pattern[m.end() :])]


def expand(patterns: list[str] | str, base: str = ".") -> list[str]:
    """Files of the patterns (";" between them, braces, ** for any depth), sorted, once each, without office lock files."""
    each = [x.strip() for p in ([patterns] if isinstance(patterns, str) else patterns) for x in p.split(";") if x.strip()]
    found = {str(Path(f).resolve()) for p in each for b in expand_braces(p) for f in glob.glob(str(Path(base, b)), recursive=True) if Path(f).is_file()}
    return sorted(f for f in found if not re.fullmatch(r"~\$.*\.xlsx?", Path(f).name))


def expand_mixed(patterns: list[str] | str, base: str = ".") -> list[str]:
    """The patterns under each of the usual data folders that exists, and as they stand."""
    each = [patterns] if isinstance(patterns, str) else patterns
    rooted = [f"{r}/{p.split('/', 1)[1] if p.split('/', 1)[0] in ROOTS and '/' in p else p}" for r in ROOTS if Path(base, r).is_dir() for p in each]
    return sorted({*expand(rooted, base), *expand(each, base)})


def keyword_files(paths: list[str], tokens: list[str]) -> list[str]:
    """Paths whose name holds a token; all of them if none does."""
    return [p for p in paths if any(t in Path(p).name.lower() for t in tokens)] or paths


def one_per_stem(paths: list[str], priority: list[str]) -> list[str]:
    rank = {e.lower(): i for i, e in enumerate(priority)}
    best: dict[str, str] = {}
    for p in paths:
        stem = Path(p).with_suffix("").name.lower()
        if stem not in best or rank.get(Path(p).suffix.lower(), len(rank)) < rank.get(Path(best[stem]).suffix.lower(), len(rank)):
            best[stem] = p
    return list(best.values())


def typed(df: DataFrame, nulls: list[str], sample: int | None = None) -> DataFrame:
    """A text table with null words gone and columns typed as whole numbers, numbers or booleans where every value fits. A
    `sample` looks at so many first rows only; a later value that doesn't fit is null then."""
    df = df.select(*(s.known_nulls(s.col(c), nulls).alias(c) for c in df.columns))
    head = df if sample is None else df.limit(sample)
    tests = {"bigint": r"^[+-]?\d{1,18}$", "double": s.LOOSE_NUMBER, "boolean": r"^(?i:true|false)$"}
    marks = [F.coalesce(F.min(s.col(c).rlike(t).cast("int")), F.lit(-1)).alias(f"{i}_{k}") for i, c in enumerate(df.columns) for k, t in tests.items()]
    seen = head.agg(*marks).first() if marks else {}
    kinds = [next((k for k in tests if seen[f"{i}_{k}"] == 1), None) for i in range(len(df.columns))]
    return df.select(*(F.when(s.col(c).rlike(tests[k]), s.col(c).try_cast(k)).alias(c) if k else s.col(c) for c, k in zip(df.columns, kinds, strict=True)))


def read_csv(spark: SparkSession, path: str, sep: str = ",", nulls: list[str] | None = None) -> DataFrame:
    raw = spark.read.option("header", True).option("sep", sep).option("mode", "PERMISSIVE").option("multiLine", True).option("escape", '"').csv(path)
    return typed(raw, s.INGEST_NULLS if nulls is None else nulls)


def tidy_json(text: str) -> str:
    """Without byte-order mark, comments outside strings, and trailing commas."""
    keep = re.compile(r'("(?:[^"\\]|\\.)*")|//[^\n]*|/\*.*?\*/', re.S)
    bare = keep.sub(lambda m: m[1] or "", text.lstrip("﻿"))
    return re.sub(r'("(?:[^"\\]|\\.)*")|,(?=\s*[}\]])', lambda m: m[1] or "", bare)


def read_json(spark: SparkSession, path: str, most: int = 1 << 28) -> DataFrame:
    """One document or one record a line; what doesn't parse is dropped. Spark parses line files and documents (comments
    may stand in them). A document with other faults is mended on the driver, up to `most` characters; a longer one is an
    error."""
    lines = spark.read.text(path).select(F.regexp_replace(F.regexp_replace("value", "^﻿", ""), r",\s*$", "").alias("value"))
    record = F.col("value").rlike(r"^\s*\{.*\}\s*$") & F.get_json_object("value", "$").isNotNull()
    full = F.trim("value") != ""
    n = lines.agg(F.count_if(full).alias("n"), F.count_if(full & record).alias("good"), F.coalesce(F.sum(F.length("value") + 1), F.lit(0)).alias("chars")).first()
    if n.n and 2 * n.good >= n.n:
        return spark.read.option("mode", "DROPMALFORMED").json(path)
    whole = spark.read.options(multiLine=True, allowComments=True, columnNameOfCorruptRecord=(bad := f"__bad_{uuid.uuid4().hex}")).json(path)
    if whole.columns and bad not in whole.columns:
        return whole
    if n.chars > most:
        raise ValueError(f"{path}: a document of {n.chars} characters that isn't valid JSON")
    text = "\n".join(r.value for r in spark.read.option("wholetext", True).text(path).collect())  # at most `most` characters
    try:
        got = json.loads(tidy_json(text))
    except ValueError:
        return spark.createDataFrame([], T.StructType([]))
    rows = got if isinstance(got, list) else [got]
    return spark.read.json(spark.sparkContext.parallelize([json.dumps(r) for r in rows if isinstance(r, dict)]))


def read_excel(spark: SparkSession, path: str) -> DataFrame:
    import pandas as pd

    return typed(spark.createDataFrame(pd.read_excel(path, dtype=str)), s.INGEST_NULLS)


def read_any(spark: SparkSession, path: str, flat: bool = True) -> DataFrame:
    kind = Path(path).suffix.lower()
    if kind in (".json", ".ndjson", ".jsonl"):
        df = read_json(spark, path)
        return flatten(df) if flat else df
    if kind in (".xlsx", ".xls"):
        return read_excel(spark, path)
    if kind == ".parquet":
        return spark.read.parquet(path)
    if kind == ".tsv":
        return read_csv(spark, path, "\t", s.UPLOAD_NULLS)
    return read_csv(spark, path, nulls=s.INGEST_NULLS if kind == ".csv" else [])


def flatten(df: DataFrame) -> DataFrame:
    """One round: a row for each element of every list of structs, then struct fields as columns; a name that is taken gets
    its struct's name before it."""
    for f in df.schema:
        if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType):
            df = df.withColumn(f.name, F.explode_outer(s.col(f.name)))
    out, taken = [], {f.name for f in df.schema if not isinstance(f.dataType, T.StructType)}
    for f in df.schema:
        if not isinstance(f.dataType, T.StructType):
            out.append(s.col(f.name))
            continue
        for g in f.dataType.fieldNames():
            name = g if g not in taken else f"{f.name}_{g}"
            taken.add(name)
            out.append(s.col(f.name)[g].alias(name))
    return df.select(*out)


def with_row(df: DataFrame) -> DataFrame:
    return df.withColumn(ROW, F.monotonically_increasing_id())


def preview(df: DataFrame) -> tuple[list[str], list]:
    row = df.limit(1).collect()
    return df.columns, list(row[0]) if row else []


def write_csv(df: DataFrame, path: str, null: str = "None") -> None:
    """Parts in parallel under one folder."""
    df.select(*(s.text_of(s.col(c)).alias(c) for c in df.columns)).write.mode("overwrite").option("header", True).option("nullValue", null).option("emptyValue", "").csv(path)


def write_meta(meta: dict, path: str) -> None:
    Path(path).write_text(json.dumps(meta, indent=1, ensure_ascii=False, default=str))


def row_cap(df: DataFrame, rows: int | None, order: list[str]) -> DataFrame:
    """The first rows in an order, as a top-k (each task keeps `rows` of its own); all of them where `rows` is None."""
    return df if rows is None else df.orderBy(*order).limit(rows)
