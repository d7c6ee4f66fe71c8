import json

import duckdb
import pytest
from pyspark.sql import functions as F

from meshwright.functions import profile as p
from meshwright.functions import scalars as s
from meshwright.operators import clean, knowledge, merge, resolve
from meshwright.plans.advisor import HeuristicAdvisor
from meshwright.plans.pipeline import Config, process, run_batch
from meshwright.queries import QUERIES, SQL
from meshwright.sources import files
from meshwright.streaming.cleaning import clean_stream, rules_from

SF = "/root/testdata/sf0.001"


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    one = lambda v: "N" if v is None else f"{float(v):.4f}" if isinstance(v, int | float) and not isinstance(v, bool) else str(v)
    return sorted(tuple(one(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_agrees_with_sql(spark, name):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    want = con.execute(SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(columns)
    assert _rows(df.columns, [tuple(r) for r in df.collect()]) == _rows(columns, want.fetchall())


def test_scalars(spark):
    df = spark.createDataFrame([("1,000", "1000.0"), ("5", "5.02"), (None, "x"), (None, None)], "a string, b string")
    assert [r[0] for r in df.select(s.values_agree(F.col("a"), F.col("b"))).collect()] == [True, False, False, True]
    text = spark.createDataFrame([("released 1899",), ("born 1999, moved 2003",), ("X is an American company",), ("Inception is a 2010 film",)], "t string")
    assert [r[0] for r in text.select(s.first_year(F.col("t"))).collect()] == [None, 1999, None, 2010]
    assert [r[0] for r in text.select(s.is_a_phrase(F.col("t"))).collect()][2:] == ["american company", None]
    odd = spark.createDataFrame([("5d",), ("1e3",), (" $1,2.5 ",), ("",), (None,)], "v string")
    assert [r[0] for r in odd.select(s.to_number(F.col("v"))).collect()] == [None, None, 12.5, None, None]
    assert odd.select(s.to_number_loose(F.col("v"))).collect()[1][0] == 1000.0


def test_readers(spark, tmp_path):
    (tmp_path / "players.csv").write_text('id,name,pts\n1,"A, B",10\n2,--,N/A\n3,C,"x"\n')
    rows = files.read_any(spark, str(tmp_path / "players.csv")).orderBy("id").collect()
    assert [tuple(r) for r in rows][:2] == [(1, "A, B", "10"), (2, None, None)]
    (tmp_path / "teams.ndjson").write_text('{"id": 1, "t": "x"},\nbroken\n{"id": 2, "t": "y"}\n')
    assert files.read_any(spark, str(tmp_path / "teams.ndjson")).count() == 2
    (tmp_path / "notes.json").write_text('﻿[ // c\n {"id": 1, "u": "http://a"}, /* x */ {"id": 2,}, ]')
    assert {tuple(r) for r in files.read_any(spark, str(tmp_path / "notes.json")).select("id", "u").collect()} == {(1, "http://a"), (2, None)}
    (tmp_path / "nested.json").write_text(json.dumps([{"id": 1, "stats": [{"season": 1, "pts": 2}, {"season": 2, "pts": 3}], "info": {"height": 7, "id": 9}}]))
    flat = files.read_any(spark, str(tmp_path / "nested.json"))
    assert flat.count() == 2 and {"season", "pts", "height", "info_id"} <= set(flat.columns)


def test_cleaning_is_idempotent_and_logged(spark):
    df = spark.createDataFrame([(1, " A ", "1,000"), (2, "a", "x"), (3, None, "5"), (4, "b", "6"), (5, "B", "7"), (6, "b", "8")], "id long, kind string, n string")
    out, log, report = clean.clean_data(df, ["id"], "fast")
    assert out.count() == 6 and [r.id for r in out.orderBy("id").collect()] == [1, 2, 3, 4, 5, 6]
    assert report.cleaned_cells == log.count() and "kind" in report.cleaned_columns
    again = clean.clean_data(out, ["id"], "fast")[2]
    assert again.cleaned_cells == 0
    with pytest.raises(ValueError):
        clean.clean_data(df, ["id"], "nope")
    for mode in ("ultra", "hybrid", "batch", "type"):
        assert clean.clean_data(df, ["id"], mode, HeuristicAdvisor())[0].count() == 6
    empty = clean.clean_data(df.limit(0), ["id"], "fast")
    assert empty[0].count() == 0 and empty[2].cleaned_cells == 0


def test_merge_nulls_and_guard(spark):
    a = spark.createDataFrame([(1, "x", 1), (1, "y", 2), (None, "z", 3)], "id long, v string, o int")
    kept = merge.keep_first(a, ["id"], [F.col("o")])
    assert {(r.id, r.v) for r in kept.collect()} == {(1, "x"), (None, "z")}
    assert not merge.safe_blowup(a, a.limit(0), ["id"], 1.8) and merge.safe_blowup(a, a, ["id"], 1.8)
    b = spark.createDataFrame([("1", "new")], "id string, v string")
    assert {(r.id, r.v) for r in merge.merge_pair(kept, b, ["id"], "full").collect()} == {("1", "new"), (None, "z")}


def test_imputation_and_validation_keep_what_is_there(spark):
    df = spark.createDataFrame([(1, "A", 5.0), (2, "b ", None), (3, "zz", None)], "id long, name string, budget double")
    source = knowledge.KnowledgeSource("kb", spark.createDataFrame([("a", 9.0), ("B", 7.0)], "name string, budget double"))
    filled = knowledge.impute(df, ["id"], ["budget"], [source], F.col("name"))
    assert [r.budget for r in filled.orderBy("id").collect()] == [5.0, 7.0, None]
    out, log, report = knowledge.validate_all(filled, ["id"], ["budget"], [(source, "tmdb")])
    assert log.count() == report.corrected_cells >= 0 and out.count() == 3


def test_resolution(spark):
    df = spark.createDataFrame([(i, n, float(i)) for i, n in enumerate(["acme corp", "Acme Corp", "beta llc", "gamma"])], "rid long, name string, x double")
    merged, report = resolve.resolve_entities(df, "name", "rid")
    assert merged.count() == 3 and [(r.cluster_id, r.records_merged) for r in report.collect()] == [(0, 2)]


def test_quartiles_agree_with_sorting(spark):
    values = [float(i % 7) for i in range(101)]
    q = p.iqr_bounds(spark.createDataFrame([(v,) for v in values], "v double"), "v").first()
    assert (q.q25, q.q75) == (sorted(values)[25], sorted(values)[75])


def test_process_end_to_end(spark, tmp_path):
    lake = tmp_path / "data"
    lake.mkdir()
    (lake / "wine_a.csv").write_text("id,ph,quality\n1,3.1,5\n2,3.3,6\n2,9,9\n")
    (lake / "wine_b.ndjson").write_text('{"id": 2, "quality": 8}\n{"id": 3, "quality": 7}\n')
    (lake / "wine_keyless.csv").write_text("note\nhello\n")
    r = process(spark, Config("I need wine database with id, ph and quality", ["*.{csv,ndjson}"], str(lake), str(tmp_path)))
    rows = {(x.id, x.quality) for x in r.table.collect()}
    assert {i for i, _ in rows} >= {1.0, 2.0, 3.0} and r.meta["join_keys"] == ["id"] and (tmp_path / "meta.json").exists()
    assert run_batch(spark, ["nothing"], Config(base=str(tmp_path / "void")))[0]["success"] is False


def test_streaming_cleaner(spark, tmp_path):
    batch = spark.createDataFrame([(1, " A "), (2, "b"), (3, "a")], "id long, kind string")
    batch.write.parquet(str(tmp_path / "in"))
    stream = clean_stream(spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in")), rules_from(batch, ["id"]), ["id"])
    q = stream.writeStream.format("memory").queryName("cleaned").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(60)
    assert {(r.id, r.kind) for r in spark.table("cleaned").collect()} == {(1, "a"), (2, "b"), (3, "a")}


def test_similar_values_against_all_pairs(spark):
    import random

    from meshwright.operators import clean

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    rng = random.Random(4)
    base = ["AUTOMOBILE", " AUTOMOBILE", "HOUSEHOLD", " HOUSEHOLD", "machinery", " MACHINERY", "", "x"] + ["".join(rng.choice("abc ") for _ in range(n)) for n in (20, 31, 40, 100)]
    values = set(base)
    for v in base[8:]:
        for _ in range(6):
            w = list(v)
            for _ in range(rng.randint(1, len(v) // 9)):
                k = rng.randrange(len(w))
                w[k : k + 1] = rng.choice([[], ["z"], ["z", w[k]]])
            values.add("".join(w))
    values.add(base[-1][10:])  # lengths 100 and 90
    values = sorted(values)
    root = list(range(len(values)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(values):
        for j, b in enumerate(values[:i]):
            if 10 * distance(a.lower(), b.lower()) <= max(len(a), len(b)):
                root[find(i)] = find(j)
    got = {r.value: r.representative for r in clean.similar_values(spark.createDataFrame([(v, 1) for v in values], "value string, n long")).collect()}
    assert got == {v: max(w for j, w in enumerate(values) if find(j) == find(i)) for i, v in enumerate(values)}
