"""A training corpus from raw documents: language ID, exact dedup, near dedup, personal data, packing.

Each stage reads what its predecessor wrote as Parquet. All but the last return the columns of `documents`; the last
returns one row per packed piece.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwright.llm._text import delete, fresh, numbered, shared_folder
from meshwright.llm.exact_dedup import exact_dedup
from meshwright.llm.language_id import identify
from meshwright.llm.near_dedup import near_duplicates
from meshwright.llm.packing import pack
from meshwright.llm.pii import redact


def _judged(docs: DataFrame, judge: Callable[..., DataFrame]) -> DataFrame:
    """docs joined with the verdicts of judge(docs, row=...) where kept = true; a column of a verdict is told by a prefix.

    Both sides carry one identity of the row, made here, so that no number is made twice."""
    row = fresh("__row", docs.columns)
    rows = numbered(docs, row)
    said = judge(rows, row=row).where("kept")
    said = said.select(*(F.col(c).alias(fresh(f"__said_{c}", docs.columns)) for c in said.columns))
    return rows.join(said, F.col(row) == F.col(fresh("__said___rid", docs.columns)))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language; the accepted ones carry the language that the evidence gives."""
    out = _judged(docs, lambda rows, row: identify(rows, declared=F.col("lang"), host=F.col("source"), row=row))
    return out.withColumn("lang", F.col(fresh("__said_lang", docs.columns))).select(*docs.columns)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _judged(docs, lambda rows, row: exact_dedup(rows, keep="max", row=row)).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _judged(docs, lambda rows, row: near_duplicates(rows, row=row)).select(*docs.columns)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = redact(docs)
    return clean.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else clean


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("personal_data", redact_personal_data),
    ("best_fit_packing", pack_sequences),
]

#: Hashes of a model's verdicts, near-duplicate classes and packings aren't expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to `documents`; each result is written to the shared folder, and dropped when the next one is."""
    where = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(out := f"{where}/{k}-{name}")
        docs = spark.read.parquet(out)
        if before:
            delete(spark, before)
        before = out
    return docs
