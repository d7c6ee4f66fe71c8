"""Profiles from sketches, readers over whole files, dictionaries computed once."""

import json
from unittest import mock

import pytest

from meshwright.functions import profile as p
from meshwright.operators import clean
from meshwright.plans.advisor import HeuristicAdvisor
from meshwright.plans.pipeline import Config, batch_summary, run_batch
from meshwright.sources import files


def test_profile_counts_exactly_where_a_decision_could_turn(spark):
    df = spark.range(20_000).selectExpr("cast(id as string) AS key", "cast(id % 7 as string) AS few", "if(id % 2 = 0, 'A', 'a') AS cased", "cast(id % 399 as string) AS near", "cast(if(id % 3 = 0, null, id % 2000) as string) AS gaps", "cast(null as string) AS none")
    exact, default, sketch = p.profile(df, approximate=False), p.profile(df), p.profile(df, approximate=True)
    for n in ("few", "cased", "near", "none"):
        assert default[n] == exact[n]
    for seen in (default, sketch):
        for n in df.columns:
            assert abs(seen[n].distinct - exact[n].distinct) <= max(1, 0.05 * exact[n].distinct) and seen[n].distinct <= 20_000
    assert default["few"].distinct == 7 and (default["cased"].lowered, default["cased"].present_distinct) == (1, 2) and default["none"].distinct == 1
    assert clean.fast_rules(default).keys() == clean.fast_rules(exact).keys() and clean.complex_columns(default, []) == clean.complex_columns(exact, [])
    assert p.profile(df.limit(0))["few"].distinct == 0


def test_default_profile_expands_no_rows(spark):
    df = spark.range(1000).selectExpr("cast(id as string) AS a", "cast(id % 3 as string) AS b")
    plans = []
    agg = type(df).agg
    with mock.patch.object(type(df), "agg", lambda self, *x: plans.append(agg(self, *x)) or plans[-1]):
        p.profile(df)
    assert len(plans) == 2 and not any("Expand" in x._jdf.queryExecution().optimizedPlan().toString() for x in plans)


def test_types_come_from_all_rows(spark, tmp_path):
    (tmp_path / "late.csv").write_text("id,v\n" + "".join(f"{i},{i}\n" for i in range(12_000)) + "12000,late\n")
    assert files.read_csv(spark, str(tmp_path / "late.csv")).where("v = 'late'").count() == 1
    raw = spark.createDataFrame([("1",), ("x",)], "v string").coalesce(1)
    assert [r.v for r in files.typed(raw, [], sample=1).collect()] == [1, None]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ('{"a": 1}\n{"a": 2},\n\n[\n', [1, 2]),
        ('﻿{"a": 1}\n{"a": 2}', [1, 2]),
        ('[\n {"a": 1}, // one\n {"a": 2}\n]', [1, 2]),
        ('[{"a": 1}, 3]', [1]),
        ('[{"a": 1,},\n]', [1]),
        ('{"a":\n 4}', [4]),
    ],
)
def test_json_shapes(spark, tmp_path, text, want):
    (tmp_path / "x.json").write_text(text)
    assert sorted(r.a for r in files.read_json(spark, str(tmp_path / "x.json")).collect()) == want


def test_json_that_is_none(spark, tmp_path):
    (tmp_path / "x.json").write_text("no json\n{")
    assert files.read_json(spark, str(tmp_path / "x.json")).columns == []
    (tmp_path / "y.json").write_text("")
    assert files.read_json(spark, str(tmp_path / "y.json")).columns == []
    (tmp_path / "z.json").write_text(json.dumps([{"a": 1}], indent=1)[:-1] + ",]")
    with pytest.raises(ValueError, match="valid JSON"):
        files.read_json(spark, str(tmp_path / "z.json"), most=5)


def test_a_dictionary_is_computed_once(spark):
    class Counting(HeuristicAdvisor):
        calls = 0

        def value_dictionary(self, df, column, budget):
            Counting.calls += 1
            return super().value_dictionary(df, column, budget)

    df = spark.createDataFrame([(i, v) for i, v in enumerate(["Red-Wine!", "Red-Wine!", "red-wine!", "Blue--", "green?"])], "k long, t string")
    out, log, _ = clean.clean_data(df, ["k"], "ultra", Counting(), {"budget": False})
    assert Counting.calls == 1 and out.where("t = 'red-wine!'").count() + out.where("t = 'Red-Wine!'").count() == 3 and out.select("t").distinct().count() == 3


def test_a_batch_tells_seconds_and_totals(spark, tmp_path):
    told = run_batch(spark, ["wine database with id"], Config(base=str(tmp_path)))
    assert [r["success"] for r in told] == [False] and told[0]["seconds"] >= 0
    assert batch_summary(told) == {"total": 1, "success": 0, "failed": 1, "average_seconds": told[0]["seconds"]}
    assert batch_summary([]) == {"total": 0, "success": 0, "failed": 0, "average_seconds": 0.0}
