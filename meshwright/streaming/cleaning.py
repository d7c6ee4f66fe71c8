"""The stateless cleaning rules over a stream: rules come from a profile of a batch, the stream applies them."""

from __future__ import annotations

from pyspark.sql import DataFrame

from meshwright.functions.profile import profile
from meshwright.operators.clean import Rule, apply_rules, fast_rules


def rules_from(batch: DataFrame, keys: list[str]) -> dict[str, Rule]:
    return fast_rules(profile(batch, [c for c in batch.columns if c not in keys]))


def clean_stream(stream: DataFrame, rules: dict[str, Rule], keys: list[str]) -> DataFrame:
    """One projection; no state, so no watermark is needed."""
    return apply_rules(stream, rules, keys)
