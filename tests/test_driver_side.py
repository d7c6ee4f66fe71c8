import pytest
from pyspark.sql import types as T

from meshwright.operators import align, knowledge, merge, quality
from meshwright.plans import textrules as tr
from meshwright.plans.templates import DomainTemplate, TemplateStore, fallback_template, fuzzy_mapping, preferred_id
from meshwright.sources import files


def test_braces_globs_and_priorities(tmp_path):
    assert files.expand_braces("a.{csv,json}") == ["a.csv", "a.json"]
    for n in ("players.csv", "players.json", "~$lock.xlsx", "teams.ndjson"):
        (tmp_path / n).write_text("x")
    found = files.expand("*.{csv,json};*.xlsx", str(tmp_path))
    assert [f.rsplit("/", 1)[1] for f in found] == ["players.csv", "players.json"]
    assert files.one_per_stem(["a.json", "a.csv"], [".csv", ".json"]) == ["a.csv"]
    assert files.keyword_files(["wine.csv", "cat.csv"], ["wine"]) == ["wine.csv"] and files.keyword_files(["a"], ["z"]) == ["a"]


def test_question_parsing():
    q = "I need wine database with id, ph and quality"
    assert tr.requested_columns(q) == ["id", "ph", "quality"] and tr.domain_keyword(q) == "wine" and tr.topic_keyword(q) == "wine"
    assert tr.requested_columns("show me wines") == [] and tr.requested_columns(None) == []
    assert tr.file_tokens("find red wine quality dataset") == ["find", "red", "wine", "quality"]
    assert tr.parse_mapping("- title → movie_title (index = 2)\n- x -> none") == {"title": "movie_title"}
    assert tr.parse_keys("- id\n* none\n- date") == ["id", "date"]
    assert tr.entity_domain(["movie_title"]) == "movie" and tr.entity_type(["player_id"], []) == "player"
    assert tr.detect_domain(["ticker", "close"]) == "stock" and tr.detect_domain(["x"]) == "generic"
    assert tr.lenient_json('Sure:\n```json\n{"a": 1}\n```') == {"a": 1} and tr.lenient_json("no") is None
    assert tr.same_entity_answer('{"same": true, "confidence": 0.9}') == (True, 0.9)


def test_header_scores_and_choice():
    assert align.header_score("wine_id", "id", "wine") == pytest.approx(37.3)  # 0.3 * (8 - 7) for shortness
    assert align.header_score("id", "id", "wine") == pytest.approx(19.8)
    assert align.best_header(["id", "wine_id"], "id", "wine") == "wine_id"
    assert align.best_header(["zzzzzzzzzz"], "id", "wine") is None


def test_types_and_joins():
    i, d, s, b = T.IntegerType(), T.DateType(), T.StringType(), T.BooleanType()
    assert align.unified_type([i, i]) == T.DoubleType() and align.unified_type([i, b]) == T.DoubleType() and align.unified_type([d, d]) == d
    assert align.unified_type([d, b]) == s and align.unified_type([s, i]) == s and align.unified_type([T.NullType()]) == s
    p = merge.MergePolicy(["id"], ["a", "b", "c"])
    assert merge.join_columns(["a", "b", "c"], ["a", "b", "c"], p) == ["a", "b"]
    strong = merge.MergePolicy(["date"], strong_keys=["entity_id"])
    assert merge.strong_enough(["date", "entity_id"], strong) and not merge.strong_enough(["entity_id"], strong) and not merge.strong_enough(["date", "name"], strong)


def test_templates(tmp_path):
    t = DomainTemplate("wine", alias_rules={"^(year|vintage)$": "vintage"}, join_keys=["vintage"])
    assert t.canonical_name("Year ") == "vintage" and t.key_candidates(["year", "ph"]) == ["year"]
    assert t.fix_aliases(["Year"], {}) == {"vintage": "Year"} and t.correct({"a": None, "b": "year"}) == {"b": "vintage"}
    assert fuzzy_mapping(["entityname"], ["entity_name"]) == {"entityname": "entity_name"}
    assert preferred_id(["id", "wine_id"], "wine") == "wine_id" and fallback_template(["b", "a", "c"]).join_keys == ["a", "b"]
    store = TemplateStore(tmp_path / "t.json")
    store.put("Q one", {"domain": "wine", "join_keys": ["id"], "policy": {"join_min_keys": 1}})
    assert store.get("q ONE").min_keys == 1 and store.get("other") is None


def test_scores():
    assert quality.overall(0.8, 0.9, 1, 0, 0) == 71.0
    assert quality.join_accuracy(1000, 300, 0.5) == pytest.approx(0.8333, abs=1e-4)
    assert knowledge.match_field("release_year", ["year"], "tmdb") == "year" and knowledge.match_field("plot", ["description"], "omdb") == "description"
    with pytest.raises(ValueError):
        knowledge.validation_sources("nowhere", {})
