"""Imputation and validation against knowledge sources: tables keyed by entity name, joined rather than called."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshwright.functions import scalars as s

NAME_COLUMNS = ["name", "title", "entity_name", "movie_title", "product_name", "company_name", "ticker", "symbol", "brand"]
TMDB_FIELDS = [
    ("year", ["year", "release_year"]), ("title", ["title", "name"]), ("director", ["director"]), ("genre", ["genre", "genres"]), ("budget", ["budget"]),
    ("revenue", ["revenue", "box_office"]), ("runtime", ["runtime", "duration"]), ("rating", ["rating", "score"]), ("description", ["description", "overview", "summary"]),
]
OMDB_FIELDS = [
    ("year", ["year"]), ("title", ["title"]), ("director", ["director"]), ("cast", ["cast", "actors"]), ("genre", ["genre"]), ("runtime", ["runtime", "duration"]),
    ("imdb_rating", ["imdb_rating", "rating"]), ("imdb_id", ["imdb_id"]), ("description", ["description", "plot"]), ("box_office", ["box_office", "revenue"]),
]
WIKI_CLASSES = [
    (["year"], ["year"]), (["description", "summary", "overview"], ["description", "summary", "extract"]), (["name", "title"], ["name", "title"]), (["category", "type", "genre"], ["category", "type"]),
]
DOMAIN_PROVIDERS = {"movie": ["tmdb", "omdb", "wikipedia", "kaggle"], "stock": ["wikipedia", "kaggle"], "ecommerce": ["wikipedia", "kaggle"]}


@dataclass(frozen=True)
class KnowledgeSource:
    """A table with one row an entity; a name that occurs twice keeps its first row by all columns."""

    name: str
    table: DataFrame
    key: str = "name"
    exact: bool = True  # numbers and case (True) or loose text (False) in validation

    def keyed(self) -> DataFrame:
        from meshwright.operators.merge import keep_first

        k = self.table.withColumn("__key", s.name_key(s.col(self.key))).where(~s.is_missing(F.col("__key")))
        return keep_first(k, ["__key"], [s.text_of(s.col(c)) for c in self.table.columns])


def entity_name(df: DataFrame, keys: Sequence[str]) -> Column:
    """The first present value of the keys, then of the usual name columns, then of any text column."""
    text = [f.name for f in df.schema if f.dataType.simpleString() == "string"]
    order = list(dict.fromkeys([*keys, *(c for c in NAME_COLUMNS if c in df.columns), *text]))
    return F.coalesce(*(F.when(~s.is_missing(s.col(c)), s.strip(s.col(c))) for c in order)) if order else F.lit(None).cast("string")


def _with_knowledge(df: DataFrame, source: KnowledgeSource, name: Column) -> DataFrame:
    k = source.keyed()
    k = k.select("__key", *(s.col(c).alias(f"__k_{c}") for c in source.table.columns), F.lit(True).alias("__known"))
    return df.withColumn("__name", s.name_key(name)).join(k, F.col("__name") == F.col("__key"), "left")


def impute(df: DataFrame, keys: list[str], columns: list[str], sources: list[KnowledgeSource], name: Column | None = None) -> DataFrame:
    """Fills missing cells of the columns from the sources in order; present cells and keys never change."""
    name = entity_name(df, keys) if name is None else name
    out, todo = df, [c for c in columns if c in df.columns and c not in keys]
    for source in sources:
        have = [c for c in todo if c in source.table.columns]
        if not have:
            continue
        j = _with_knowledge(out, source, name)
        out = j.select(*(F.when(s.is_missing(s.col(c)) & ~s.is_missing(s.col(f"__k_{c}")), s.col(f"__k_{c}").try_cast(df.schema[c].dataType)).otherwise(s.col(c)).alias(c) if c in have else s.col(c) for c in df.columns))
    return out


def imputation_changes(before: DataFrame, after: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """(keys, column, before, after) of newly filled cells."""
    b = before.select(*(s.col(k) for k in keys), *(s.text_of(s.col(c)).alias(f"__b_{c}") for c in columns))
    j = b.join(after.select(*(s.col(k) for k in keys), *(s.text_of(s.col(c)).alias(f"__a_{c}") for c in columns)), keys)
    cells = [F.when(s.is_missing(s.col(f"__b_{c}")) & ~s.is_missing(s.col(f"__a_{c}")), F.struct(F.lit(c).alias("column"), s.col(f"__b_{c}").alias("before"), s.col(f"__a_{c}").alias("after"))) for c in columns]
    return j.select(*(s.col(k) for k in keys), F.inline(F.array_compact(F.array(*cells))))


def imputation_summary(changes: DataFrame, rows: int) -> DataFrame:
    """(column, filled_cells, sample_size, filled_ratio), only columns with a filled cell."""
    return changes.groupBy("column").agg(F.count(F.lit(1)).alias("filled_cells")).select("column", "filled_cells", F.lit(rows).cast("long").alias("sample_size"), F.round(F.col("filled_cells") / max(1, rows), 4).alias("filled_ratio"))


def wiki_fields(table: DataFrame, title: str = "title", text: str = "extract") -> DataFrame:
    """An encyclopedia dump as a knowledge table: name, description, summary, year, release_year, category, type."""
    body = s.col(text)
    return table.select(
        s.col(title).alias("name"), body.alias("description"), body.alias("summary"), s.first_year(body).alias("year"), s.first_year(body).alias("release_year"),
        F.coalesce(s.keyword_category(body), s.is_a_phrase(body)).alias("category"), s.keyword_category(body).alias("type"),
    )


def tmdb_fields(details: DataFrame) -> DataFrame:
    """title, release_date, overview, genres[{name}], budget, revenue, runtime, vote_average, crew[{name, job}], cast[{name}]."""
    directors = F.filter("crew", lambda x: x.job == "Director")
    return details.select(
        F.col("title").alias("name"), "title", s.first_year(F.col("release_date")).alias("year"), F.col("overview").alias("description"), F.array_join(F.transform("genres", lambda g: g["name"]), ", ").alias("genre"),
        "budget", "revenue", "runtime", F.col("vote_average").alias("rating"), F.get(directors, 0)["name"].alias("director"), F.array_join(F.slice(F.transform("cast", lambda x: x["name"]), 1, 5), ", ").alias("cast"),
    )


def omdb_fields(records: DataFrame) -> DataFrame:
    """Capitalised text fields; N/A is null."""
    has = lambda c: F.when(F.col(c) != "N/A", F.col(c)) if c in records.columns else F.lit(None).cast("string")
    return records.select(
        has("Title").alias("name"), has("Title").alias("title"), s.first_year(has("Year")).alias("year"), has("Director").alias("director"), has("Actors").alias("cast"), has("Genre").alias("genre"),
        s.money(has("Runtime")).alias("runtime"), s.money(has("imdbRating")).alias("imdb_rating"), has("imdbID").alias("imdb_id"), has("Plot").alias("description"), s.money(has("BoxOffice")).alias("box_office"),
    )


def match_field(column: str, fields: list[str], kind: str) -> str | None:
    """The source's field for a column: its own name, else by the source kind's fixed aliases."""
    low = column.lower()
    if column in fields:
        return column
    if kind == "wikipedia":
        for words, targets in WIKI_CLASSES:
            if any(w in low for w in words):
                return next((t for t in targets if t in fields), None)
        return None
    for target, words in TMDB_FIELDS if kind == "tmdb" else OMDB_FIELDS:
        if target in fields and any(w in low for w in words):
            return target
    return None


@dataclass
class ValidationReport:
    validated_cells: int = 0
    corrected_cells: int = 0
    validated_rows: int = 0
    corrected_rows: int = 0
    accuracy_before: float = 1.0
    accuracy_after: float = 1.0
    sources: dict[str, int] = field(default_factory=dict)


def validate(df: DataFrame, keys: list[str], columns: list[str], source: KnowledgeSource, kind: str = "tmdb", name: Column | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(corrected, corrections, counts): cells that disagree with the source take its value. corrections: (keys, column,
    old_value, new_value, source, reason); counts: one row (validated_cells, validated_rows)."""
    name = entity_name(df, keys) if name is None else name
    j = _with_knowledge(df, source, name)
    todo = [c for c in columns if c in df.columns and c not in keys]
    field_of = {c: f for c in todo if (f := match_field(c, source.table.columns, kind))}
    agree = s.values_agree if source.exact else s.texts_agree
    wrong = {c: F.coalesce(F.col("__known"), F.lit(False)) & ~s.is_missing(s.col(f"__k_{f}")) & ~agree(s.text_of(s.col(c)), s.text_of(s.col(f"__k_{f}"))) for c, f in field_of.items()}
    fixed = j.select(*(F.when(wrong[c], s.col(f"__k_{field_of[c]}").try_cast(df.schema[c].dataType)).otherwise(s.col(c)).alias(c) if c in wrong else s.col(c) for c in df.columns))
    cells = [
        F.when(wrong[c], F.struct(F.lit(c).alias("column"), s.text_of(s.col(c)).alias("old_value"), s.text_of(s.col(f"__k_{f}")).alias("new_value"), F.lit(source.name).alias("source"), F.lit("Value differs from source").alias("reason")))
        for c, f in field_of.items()
    ]
    schema = "array<struct<column:string,old_value:string,new_value:string,source:string,reason:string>>"
    corrections = j.select(*(s.col(k) for k in keys), F.inline(F.array_compact(F.array(*cells)) if cells else F.array().cast(schema)))
    known = F.coalesce(F.sum(F.col("__known").cast("long")), F.lit(0))
    return fixed, corrections, j.agg((known * len(todo)).alias("validated_cells"), known.alias("validated_rows"))


def validate_all(df: DataFrame, keys: list[str], columns: list[str], sources: list[tuple[KnowledgeSource, str]]) -> tuple[DataFrame, DataFrame | None, ValidationReport]:
    """Sources in order; a later one sees earlier corrections."""
    out, logs, r = df, [], ValidationReport()
    for source, kind in sources:
        out, log, counts = validate(out, keys, columns, source, kind)
        c = counts.first()
        r.validated_cells += c.validated_cells
        r.validated_rows = max(r.validated_rows, c.validated_rows)
        logs.append(log)
    log = reduce(DataFrame.unionByName, logs) if logs else None
    if log is not None:
        by = log.groupBy("source").agg(F.count(F.lit(1)).alias("n")).collect()
        r.sources = {x["source"]: x.n for x in by}
        r.corrected_cells = sum(r.sources.values())
        r.corrected_rows = log.select(*keys).distinct().count() if keys else 0
    r.accuracy_before = (r.validated_cells - r.corrected_cells) / max(1, r.validated_cells) if r.validated_cells else 1.0
    return out, log, r


def validation_sources(source: str, have: dict[str, KnowledgeSource]) -> list[tuple[KnowledgeSource, str]]:
    """wikipedia, tmdb, omdb or comprehensive; a source that isn't at hand falls back to wikipedia."""
    if source not in ("wikipedia", "tmdb", "omdb", "comprehensive"):
        raise ValueError(f"unknown validation source: {source}")
    names = ["tmdb", "omdb", "wikipedia"] if source == "comprehensive" else [source if source in have else "wikipedia"]
    return [(have[n], n) for n in names if n in have]


def imputation_sources(domain: str, have: dict[str, KnowledgeSource]) -> list[KnowledgeSource]:
    alias = {"film": "movie", "equity": "stock", "retail": "ecommerce"}
    return [have[n] for n in DOMAIN_PROVIDERS.get(alias.get(domain, domain), ["wikipedia"]) if n in have]
