"""Row identities, lineage cuts and connected components."""

import random

import pytest
from pyspark.sql import functions as F

from meshwright.functions import iterate


def _brute(links):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        lo, hi = sorted((find(a), find(b)))
        root[hi] = lo
    return {x: find(x) for x in root}


@pytest.mark.parametrize("alone", [1 << 20, 0])
def test_components_at_once_and_upon_known_labels(spark, alone):
    rng = random.Random(4)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(1000 + i, 1001 + i) for i in range(40)]
    links = [(a, b) for a, b in links if a != b]
    frame = lambda x: spark.createDataFrame(x, "a long, b long")
    once = {r.id: r.label for r in iterate.components(frame(links), alone=alone).collect()}
    assert once == _brute(links)
    known = iterate.components(frame(links[:100]), alone=alone)
    assert {r.id: r.label for r in iterate.components(frame(links[100:]), known, alone).collect()} == once
    assert iterate.components(frame([]), alone=alone).count() == 0
    assert {r.id: r.label for r in iterate.components(frame([]), known, alone).collect()} == _brute(links[:100])


def test_cut_coalesces_by_the_rows_it_saw(spark):
    assert iterate.cut(spark.range(0, 100, 1, 4), 30).rdd.getNumPartitions() == 4
    assert iterate.cut(spark.range(0, 100, 1, 4), 1000).rdd.getNumPartitions() == 1


@pytest.mark.parametrize("files", [10_000, 1])
def test_row_identities_hold_when_the_splits_change(spark, tmp_path, files):
    """By file and row, and (with more files than allowed) by a table that is written once."""
    spark.range(0, 20_000, 1, 3).select("id", F.repeat(F.col("id").cast("string"), 20).alias("text"), F.lit(1).alias("__path")).write.parquet(f"{tmp_path}/t")
    rows = iterate.numbered(spark.read.parquet(f"{tmp_path}/t"), "n", files)
    seen = []
    for cores, size in (("1", "128m"), ("16", "20k")):
        spark.conf.set("spark.sql.leafNodeDefaultParallelism", cores)
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "1k")
        got = rows.select("id", "n", F.spark_partition_id().alias("p")).collect()
        seen.append((len({r.p for r in got}), {r.id: r.n for r in got}))
    for x in ("leafNodeDefaultParallelism", "files.maxPartitionBytes", "files.openCostInBytes"):
        spark.conf.unset(f"spark.sql.{x}")
    assert seen[0][0] < seen[1][0] and seen[0][1] == seen[1][1] and len(set(seen[0][1].values())) == 20_000


def test_names_that_clash_and_folders(spark):
    assert iterate.fresh("__rid", ["__RID", "___rid"]) == "____rid" and iterate.fresh("x", []) == "x"
    df = spark.createDataFrame([(1, "a")], "`_metadata` int, n string")
    assert iterate.numbered(df, "__rid").columns == ["_metadata", "n", "__rid"]
