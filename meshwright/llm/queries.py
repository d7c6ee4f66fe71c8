"""The queries of this subpackage, each an operator with production parameters over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwright.llm._text import documents

SHARDS = 16


def _tokenizers():
    import public_tokenizers

    return public_tokenizers


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from meshwright.llm.html_extraction import extract_pages

    return extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op2_perplexity_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from meshwright.llm.perplexity import quality

    return quality(documents(spark, sf_dir))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from meshwright.llm.suffix_dedup import remove_repeats

    return remove_repeats(documents(spark, sf_dir)).drop("kept_text")


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from meshwright.llm.pii import find_personal_data

    return find_personal_data(documents(spark, sf_dir))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from meshwright.llm.near_dedup import near_duplicates

    return near_duplicates(documents(spark, sf_dir)).drop("__rid")


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from meshwright.llm.packing import pack

    return pack(documents(spark, sf_dir), _tokenizers().path("word_bpe_49k.json"))


def op7_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from meshwright.llm.sharding import shard_by_bytes

    placed = shard_by_bytes(documents(spark, sf_dir), SHARDS)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from meshwright.llm.bpe import bpe_round_trip

    t = _tokenizers()
    return bpe_round_trip(documents(spark, sf_dir), t.path("byte_bpe_50k.tiktoken"), t.PATTERN)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from meshwright.llm.exact_dedup import exact_dedup

    return exact_dedup(documents(spark, sf_dir), keep="max").drop("__rid")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from meshwright.llm.language_id import identify

    return identify(documents(spark, sf_dir), declared=F.col("lang"), host=F.col("source")).drop("__rid")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    each = (
        op1_html_extraction, op2_perplexity_rules, op3_suffix_dedup, op4_personal_data, op5_near_dedup, op6_best_fit_packing, op7_byte_shards, op8_byte_bpe,
        op9_exact_dedup, op10_language_id, pipeline,
    )
    return {f.__name__: f for f in each}


EXACT_DEDUP_SQL = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents) d
"""


# Rows in the order of the file, which is that of doc_id. DuckDB has no CRC-32: it is taken bit by bit, lowest first.
BYTE_SHARDS_SQL = f"""
WITH r AS (SELECT doc_id, strlen(t) + 1 AS size, hex(encode(t)) AS h, row_number() OVER (ORDER BY doc_id) AS pos FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents) d),
p AS (SELECT *, sum(size) OVER (ORDER BY pos) AS upto, sum(size) OVER () AS total,
  list_transform(range(0, length(h)), lambda i: instr('0123456789ABCDEF', substr(h, (i + 1 - 2 * (i % 2) + 1)::BIGINT, 1)) - 1) AS nibbles FROM r),
q AS (SELECT doc_id, size, pos, least({SHARDS} - 1, ((upto * 2 - size) * {SHARDS}) // (total * 2))::INT AS shard,
  list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, 4 * len(nibbles)), lambda k: ((nibbles[k // 4 + 1] >> (k % 4)::INT) & 1)::BIGINT)),
    lambda c, b: xor(c >> 1, 3988292384 * (xor(c, b) & 1))) AS c FROM p)
SELECT doc_id, size, xor(c, 4294967295) AS text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY pos) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM q
"""


def oracle_sql() -> dict[str, str]:
    return {"op7_byte_shards": BYTE_SHARDS_SQL, "op9_exact_dedup": EXACT_DEDUP_SQL}
