"""Decisions that need judgement, behind one interface with a deterministic default."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwright.functions.profile import ColumnProfile
from meshwright.operators import align, clean
from meshwright.plans import textrules
from meshwright.plans.templates import DomainTemplate, fallback_template, fuzzy_mapping


class Advisor(Protocol):
    def template(self, question: str, columns: list[str]) -> DomainTemplate: ...
    def mapping(self, columns: list[str], template: DomainTemplate) -> dict[str, str]: ...
    def relevant(self, question: str, path: str, columns: list[str]) -> bool: ...
    def cleaning_plan(self, column: ColumnProfile) -> str | None: ...
    def value_dictionary(self, df: DataFrame, column: str, budget: int | None) -> DataFrame: ...
    def same_entity(self, pairs: DataFrame, threshold: float) -> DataFrame: ...


class HeuristicAdvisor:
    def template(self, question: str, columns: list[str]) -> DomainTemplate:
        wanted = textrules.requested_columns(question)
        base = fallback_template(columns)
        if not wanted:
            return base
        keys = [c for c in wanted if c in ("id", "name", "title") or c.endswith("_id")] or wanted[:1]
        return DomainTemplate(textrules.domain_keyword(question) or "generic", wanted, keys, wanted, [], {}, keys, 1, 2.0)

    def mapping(self, columns: list[str], template: DomainTemplate) -> dict[str, str]:
        """{feature: source}: aliases, then equal names, then alike names."""
        features = [*template.features, *template.join_keys]
        out = template.fix_aliases(columns, align.mapping_by_name(columns, features))
        for source, target in fuzzy_mapping([c for c in columns if c not in out.values()], [f for f in features if f not in out]).items():
            out.setdefault(target, source)
        return out

    def relevant(self, question: str, path: str, columns: list[str]) -> bool:
        topic = textrules.topic_keyword(question)
        return bool(topic) and (topic in path.lower() or any(topic in c.lower() for c in columns))

    def cleaning_plan(self, column: ColumnProfile) -> str | None:
        if column.is_numeric:
            return "outliers"
        return "numeric" if clean.is_numeric_column(column) else "date" if clean.is_date_column(column) else None

    def value_dictionary(self, df: DataFrame, column: str, budget: int | None) -> DataFrame:
        return clean.standard_values(df, column, budget)

    def same_entity(self, pairs: DataFrame, threshold: float) -> DataFrame:
        return pairs.where(F.col("similarity") >= threshold)
