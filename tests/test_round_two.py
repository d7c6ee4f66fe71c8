"""Alias rules, request parsing, name scores, composite cleaning, and the change log's plan."""

import pytest
from pyspark.sql import functions as F

from meshwright.functions import profile as p
from meshwright.functions import scalars as s
from meshwright.operators import align, clean, merge, resolve
from meshwright.plans import templates, textrules


def test_alias_rules_mean_whole_names():
    t = templates.fallback_template(["a"])
    for name in ("idle_time", "identity", "titled", "dateline", "values_total"):
        assert t.canonical_name(name) == name
    assert [t.canonical_name(x) for x in ("ID", " title ", "Timestamp", "score")] == ["entity_name", "entity_name", "date", "value"]
    assert t.fix_aliases(["idle_time", "Id"], {})["entity_name"] == "Id"


@pytest.mark.parametrize(
    ("question", "want"),
    [
        ("I need wine database with id, ph and Quality Score", ["id", "ph", "quality_score"]),
        ("wine with: a-b / cc;dd|dd, x", ["a_b", "cc", "dd"]),
        ("movies WITH title and year with rating.", ["title", "year", "rating"]),
        ("电影 包含 title、year，rating", ["title", "year", "rating"]),
        ("without anything", []),
        ("", []),
        (None, []),
    ],
)
def test_requested_columns(question, want):
    assert textrules.requested_columns(question) == want


@pytest.mark.parametrize(
    ("question", "want"),
    [("I need wine database with id", "wine"), ("red-wine  Database", "wine"), ("x, database", None), ("database of x", None), ("我要电影数据库", "我要电影"), ("wine_databases", None), (None, None)],
)
def test_domain_keyword(question, want):
    assert textrules.domain_keyword(question) == want


def test_name_scores():
    assert align.name_score("wine_id", "id", "wine") == 2 + 20 + 30 + 40 + 3
    assert align.name_score("id", "id", "wine") == 50 + 5 + 2 + 8
    assert align.best_names([], ["id"]) == {"id": None}


def test_key_columns_and_updatable_columns(spark):
    df = spark.createDataFrame([(i, f"n{i}", "x", None if i % 2 else "") for i in range(20)], "id long, movie_title string, kind string, note string")
    assert resolve.key_columns(p.profile(df)) == ["movie_title"]
    assert resolve.key_columns(p.profile(df.select("id", "kind"))) == ["kind"]
    assert clean.updatable_columns(df, ["id"]) == ["note"] and clean.updatable_columns(df.select("id"), ["id"]) == []


def test_cleaners_in_turn_name_those_that_fail(spark):
    df = spark.createDataFrame([(1, " a ")], "k long, t string")
    run = lambda x: (clean.apply_rules(x, {"t": clean.text_rule(False)}, ["k"]), clean.changes_of(x, {"t": clean.text_rule(False)}, ["k"]), None)
    out, log, report = clean.clean_in_turn(df, {"bad": lambda x: 1 / 0, "good": run}, ["k"])
    assert out.first().t == "a" and log.count() == 1 and report.errors == ["bad: ZeroDivisionError: division by zero"] and report.format_fixes == 1
    assert clean.clean_in_turn(df, {"bad": lambda x: 1 / 0}, ["k"])[1] is None


def test_dates_are_parsed_by_shape(spark):
    df = spark.createDataFrame([(x,) for x in ("2024-1-5", "01/31/2024", "20240131", "2024-02-30", "n/a", "1/2", " 2024-12-31 ", "2024-01-01x", None)], "d string")
    assert [r[0] for r in df.select(s.to_date_text(F.col("d"))).collect()] == ["2024-01-05", "2024-01-31", "2024-01-31", None, None, None, "2024-12-31", None, None]
    assert [r[0] for r in df.select(s.to_date_digits(F.col("d"))).collect()][:4] == ["2024-01-05", "2024-01-31", None, "2024-02-30"]


def test_a_chain_runs_each_step_once(spark):
    """The guard of the third frame starts from a table that is cut."""
    a, b, c = (spark.createDataFrame([(i, f"{x}{i}") for i in range(5)], f"id long, {x} string") for x in "abc")
    policy = merge.MergePolicy(["id"], strong_keys=["id"], min_keys=1)
    out, log = merge.safe_inner_chain([a, b, c], policy, [[F.col("a")], [F.col("b")], [F.col("c")]])
    assert sum(x["joined"] for x in log) == 2 and out.count() == 5 and set(out.columns) == {"id", "a", "b", "c"}
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
