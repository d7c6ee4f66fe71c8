"""Contiguous shards of nearly equal bytes from global prefix sums.

Every input partition sums its rows' sizes on its own; an exclusive prefix sum over those totals (one row a
partition) turns a row's offset within its partition into its offset within the whole table, and the table is
cut at equal multiples of total / shards. Only (key, size, checksum) move, the text never does.

Defined cases: a null text has size 1 and checksum 0 (that of no bytes); repeated rows and null keys are rows like
any other; an empty table gives no rows; a row that crosses a cut goes where its middle lies, so a row larger than
a whole share leaves the shards it covers empty. Columns of the input other than key and text are ignored, whatever
their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from meshwright.llm._text import cut


def shard_by_bytes(docs: DataFrame, shards: int = 16, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: key, size, text_crc32, shard (0-based) and slot (0-based within the shard)."""
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = cut(
        docs.select(
            F.col(key).alias("doc_id"),
            (F.octet_length(raw).cast("long") + 1).alias("size"),
            F.crc32(raw).alias("text_crc32"),
        ).withColumn("rid", F.monotonically_increasing_id())
    ).withColumn("pid", F.shiftright("rid", 33))

    # One row a partition: the only thing that is ordered as a whole.
    totals = rows.groupBy("pid").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "pid",
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rows_before"),
        F.sum("bytes").over(Window.partitionBy()).alias("total"),
    )
    here = Window.partitionBy("pid").orderBy("rid")
    placed = (
        rows.withColumn("upto", F.sum("size").over(here.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("nth", F.row_number().over(here) - 1)
        .join(offsets, "pid")
        .select(
            "doc_id",
            "size",
            "text_crc32",
            (F.col("rows_before") + F.col("nth")).alias("at"),
            F.least(
                F.lit(shards - 1).cast("long"),
                F.expr(f"((bytes_before + upto) * 2 - size) * {shards} div (total * 2)"),
            )
            .cast("int")
            .alias("shard"),
        )
    )
    placed = cut(placed)
    first = placed.groupBy("shard").agg(F.min("at").alias("first"))
    return placed.join(F.broadcast(first), "shard").select(  # one row a shard
        "doc_id", "size", "text_crc32", "shard", (F.col("at") - F.col("first")).alias("slot")
    )
