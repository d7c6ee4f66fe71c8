"""Helpers for jobs of several rounds: cutting lineage in the shared folder, row identities, and connected components."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Where none is named, a local session takes one of its own;
    on a cluster that is an error, because executors don't see each other's folders."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = os.path.join(tempfile.gettempdir(), "checkpoints")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(named)
    return named


def delete(spark: SparkSession, folder: str) -> None:
    """Deletes a folder that this engine wrote, in whatever file system it lies."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame, rows: int = 0) -> DataFrame:
    """Materialises df in the shared checkpoint folder and cuts its lineage there; with `rows`, what follows reads about
    as many rows a task, so that small tables of an iteration don't leave a shuffle file for every partition.

    With spark.cleaner.referenceTracking.cleanCheckpoints, Spark deletes the files when the driver drops the table."""
    shared_folder(df.sparkSession)
    if not rows:
        return df.checkpoint(eager=True)
    seen = Observation()
    out = df.observe(seen, F.count(F.lit(1)).alias("n")).checkpoint(eager=True)
    return out.coalesce(seen.get["n"] // rows + 1)


def fresh(name: str, taken: list[str]) -> str:
    """`name`, or a longer one that no column in `taken` has, whatever its case."""
    lower = {c.lower() for c in taken}
    while name.lower() in lower:
        name = f"_{name}"
    return name


def is_scan(df: DataFrame) -> bool:
    """Whether df is a table read from files, with nothing done to it."""
    return df._jdf.queryExecution().analyzed().getClass().getSimpleName() == "LogicalRelation"


def numbered(df: DataFrame, name: str, files: int = 10_000) -> DataFrame:
    """df with a row identity: a long that a row keeps in every later job, whatever the cluster does in between.

    A table read straight from at most `files` Parquet files takes the file's number and the row's place in it, neither of
    which depends on how files are split among tasks. Any other table is written once to the shared folder with its numbers."""
    if is_scan(df) and "_metadata" not in df.columns:
        path, at, k = (fresh(x, df.columns) for x in ("__path", "__at", "__file"))
        try:
            told = df.select("*", F.col("_metadata.file_path").alias(path), F.col("_metadata.row_index").alias(at))
        except Exception as e:  # a format without row numbers
            if type(e).__name__ != "AnalysisException":
                raise
        else:
            paths = sorted(r[0] for r in told.select(path).distinct().limit(files + 1).collect())
            if len(paths) <= files:
                number = df.sparkSession.range(0, 1, 1, 1).select(F.posexplode(F.lit(paths)).alias(k, path))
                joined = told.join(F.broadcast(number), path) if len(paths) > 1 else told.withColumn(k, F.lit(0))
                return joined.withColumn(name, F.shiftleft(F.col(k).cast("long"), 40) + F.col(at)).drop(path, at, k)
    folder = f"{shared_folder(df.sparkSession)}/rows-{uuid.uuid4().hex}"
    df.withColumn(name, F.monotonically_increasing_id()).write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.parquet(folder)


def small(df: DataFrame, limit: int = 10_000) -> DataFrame:
    """Marks a materialised table for broadcast if it has at most `limit` rows; a larger one stays for a shuffled join."""
    return F.broadcast(df) if df.count() <= limit else df


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner delete shuffle files and checkpoints of finished rounds now: it waits for the driver to
    collect its garbage, which a driver with little garbage hardly ever does."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _union_find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = x = root[up]
        return x

    for b in batches:
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            lo, hi = sorted((find(x), find(y)))
            root[hi] = lo
    ids = list(root)
    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([find(x) for x in ids], pa.int64())], ["id", "label"])


def components(links: DataFrame, known: DataFrame | None = None, alone: int = 1 << 20) -> DataFrame:
    """(id, label) of every id in links(a, b): label is the least id of its connected component.

    With `known`, labels of earlier links, the new links join whole components: only labels are linked, and the result has
    the ids of both. At most `alone` links are counted first and then joined by one task's union-find. More take rounds of
    least-neighbour labels, each followed by pointer jumping, until nothing changes; every round is cut in the shared folder,
    and nothing but a count comes to the driver."""
    rows = 50_000
    if known is not None:
        la, lb = (known.select(F.col("id").alias(x), F.col("label").alias(f"l{x}")) for x in "ab")
        links = links.join(la, "a", "left").join(lb, "b", "left").select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))
    n = Observation()
    links = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
    links = cut(links.observe(n, F.count(F.lit(1)).alias("n")), rows)
    labels = cut(links.coalesce(1).mapInArrow(_union_find, "id long, label long")) if n.get["n"] <= alone else _rounds(links, rows)
    if known is None:
        return labels
    up = labels.select(F.col("id").alias("label"), F.col("label").alias("higher"))
    old = known.join(up, "label", "left").select("id", F.coalesce("higher", "label").alias("label"))
    return cut(old.union(labels.join(known.select("id"), "id", "left_anti")), rows)


def _rounds(links: DataFrame, rows: int) -> DataFrame:
    both = cut(links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), rows)
    labels = cut(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("label")), rows)
    while True:
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("least"))
        step = labels.join(near, "id").select("id", "label", F.least("label", "least").alias("new"))
        jump = step.select(F.col("id").alias("new"), F.col("new").alias("jumped"))
        moved = Observation()
        told = step.join(jump, "new").select("id", F.least("new", "jumped").alias("label"), (F.col("label") != F.col("new")).alias("moved"))
        labels = cut(told.observe(moved, F.sum(F.col("moved").cast("int")).alias("n")).drop("moved"), rows)
        if not moved.get["n"]:
            return labels


def global_rank(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """Numbers all rows from 0 in an order, without a task that sees them all: a range partitioning, ranks within each
    partition, and offsets from one row a partition."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [f"__k{i}" for i in range(len(order))]
    named = df.withColumns(dict(zip(keys, order, strict=True)))
    rows = cut(named.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("__at", F.monotonically_increasing_id()))
    rows = rows.withColumn("__part", F.shiftright("__at", 33)).drop(*keys)
    sizes = rows.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("__part", F.coalesce(before, F.lit(0)).alias("__start"))  # one row a partition
    place = F.col("__start") + F.col("__at").bitwiseAND((1 << 33) - 1)
    return rows.join(F.broadcast(starts), "__part").withColumn(name, place).drop("__part", "__at", "__start")
