"""From a plain-language request and a folder of files to one integrated, audited table."""

from __future__ import annotations

import dataclasses
import json
import time
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwright.functions.iterate import cut
from meshwright.operators import align, clean, knowledge, merge, quality, resolve
from meshwright.plans import textrules
from meshwright.plans.advisor import Advisor, HeuristicAdvisor
from meshwright.sources import files


@dataclass
class Config:
    query: str = ""
    datasets: list[str] = field(default_factory=lambda: ["**/*.{csv,json,ndjson,jsonl,xlsx,xls}"])
    base: str = "."
    out: str | None = None
    universal_merge: bool = True
    max_files: int | None = None
    er: bool = False
    er_name: str | None = None
    mvi: bool = False
    clean_mode: str | None = "fast"
    validation: str | None = None

    @staticmethod
    def load(path: str) -> Config:
        """From JSON or YAML; unknown keys are dropped."""
        text = Path(path).read_text()
        if Path(path).suffix in (".yml", ".yaml"):
            import yaml

            body = yaml.safe_load(text)
        else:
            body = json.loads(text)
        names = {f.name for f in dataclasses.fields(Config)}
        return Config(**{k: v for k, v in body.items() if k in names})


@dataclass
class Result:
    table: DataFrame
    meta: dict
    quality: quality.QualityReport
    changes: DataFrame | None = None
    requested: DataFrame | None = None


def process(spark: SparkSession, cfg: Config, advisor: Advisor | None = None, sources: dict[str, knowledge.KnowledgeSource] | None = None) -> Result:
    advisor, sources = advisor or HeuristicAdvisor(), sources or {}
    paths = files.expand_mixed(cfg.datasets, cfg.base)
    paths = files.keyword_files(paths, textrules.file_tokens(cfg.query))
    frames = {p: files.read_any(spark, p) for p in paths}
    columns = list(dict.fromkeys(c for f in frames.values() for c in f.columns))
    template = advisor.template(cfg.query, columns)
    paths = files.one_per_stem(paths, template.source_priority) if template.same_origin else paths
    paths = paths[: cfg.max_files] if cfg.max_files else paths
    if not paths:
        raise ValueError("no dataset matches")

    mapped, wide, diagnostics = [], [], []
    for p in paths:
        m = advisor.mapping(frames[p].columns, template)
        df = files.with_row(align.rename(frames[p], m, template.passthrough))
        keys = [k for k in template.join_keys if k in df.columns]
        n = df.agg(F.count(F.lit(1)).alias("n"), (F.count_distinct(F.struct(*keys)) if keys else F.lit(None)).alias("u")).first()
        mapped.append(df)
        wide.append(len(m))
        diagnostics.append({"file": p, "rows_raw": n.n, "rows_mapped": n.n, "join_keys_used": keys, "rows_unique_on_keys": n.u, "columns_after_map": [c for c in df.columns if c != files.ROW]})

    wanted = textrules.requested_columns(cfg.query)
    topic = textrules.topic_keyword(cfg.query) if cfg.query else None
    subsets = [x for p in paths if wanted and advisor.relevant(cfg.query, p, frames[p].columns) and (x := align.requested_subset(frames[p], wanted, topic)) is not None]
    requested = align.union_distinct(subsets, wanted) if subsets else None

    policy, orders = template.policy(), [[F.col(files.ROW)] for _ in mapped]
    if cfg.universal_merge:
        table, stats = merge.universal_merge(mapped, policy, orders)
    else:
        table, log = merge.safe_inner_chain(mapped, policy, orders)
        stats = {"joins": log}
    keys = [k for k in template.join_keys if k in table.columns]
    table = cut(table.drop(files.ROW).withColumn(files.ROW, F.monotonically_increasing_id()))

    meta: dict = {"query": cfg.query, "domain": template.domain, "matched_files": paths, "join_keys": keys, "merge_mode": "universal" if cfg.universal_merge else "safe", "universal_stats": stats, "diagnostics": diagnostics, "requested_columns": wanted}
    er, fills, changes = (0, 1), (0, 1, 0), None
    if cfg.er and (name := cfg.er_name or next((c for c in keys if table.schema[c].dataType.simpleString() == "string"), None)):
        merged, found = resolve.resolve_entities(table, name, files.ROW, advisor=advisor, keep=keys)
        gone = found.agg(F.sum(F.col("records_merged") - 1).alias("n")).first().n or 0
        er = (gone, table.count())
        table = cut(merged.withColumnRenamed("cluster_id", files.ROW).drop("records_merged"))
        meta["er_merged"] = gone
    if cfg.mvi and sources:
        todo = [c for c in table.columns if c not in keys and c != files.ROW]
        filled = cut(knowledge.impute(table, keys, todo, knowledge.imputation_sources(textrules.detect_domain(table.columns, cfg.query), sources)))
        log = knowledge.imputation_changes(table, filled, [files.ROW], todo)
        n = log.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("column").alias("c")).first()
        fills = (n.n, table.count(), n.c)
        meta["imputed_cells"], table = n.n, filled
    if cfg.clean_mode:
        table, changes, report = clean.clean_data(table, keys, cfg.clean_mode, advisor, row=files.ROW)
        meta["cleaning"] = dataclasses.asdict(report)
    if cfg.validation and sources:
        table, _, report = knowledge.validate_all(table, keys or [files.ROW], [c for c in table.columns if c not in keys and c != files.ROW], knowledge.validation_sources(cfg.validation, sources))
        meta["validation"] = dataclasses.asdict(report)
    table = table.drop(files.ROW)
    rows_in, covered = sum(d["rows_raw"] for d in diagnostics), sum(bool(d["join_keys_used"]) for d in diagnostics) / len(diagnostics)
    q = quality.quality_report(table, rows_in, covered, wide, len(template.features), er, fills, policy.max_blowup)
    meta |= {"rows": q.rows, "columns": table.columns, "quality": dataclasses.asdict(q)}
    if wanted and not cfg.universal_merge:
        table = align.project(table, wanted)
    if cfg.out:
        files.write_csv(table, f"{cfg.out}/merged")
        if changes is not None:
            files.write_csv(changes, f"{cfg.out}/cleaning_report", "")
        if requested is not None:
            files.write_csv(requested, f"{cfg.out}/requested_subset")
        files.write_meta(meta, f"{cfg.out}/meta.json")
        Path(f"{cfg.out}/quality.html").write_text(quality.as_html(q))
    return Result(table, meta, q, changes, requested)


def run_batch(spark: SparkSession, questions: list[str], base: Config) -> list[dict]:
    """One row a question: success, seconds, and rows and overall score, or the error."""
    out = []
    for question in questions:
        began = time.monotonic()
        try:
            r = process(spark, dataclasses.replace(base, query=question))
            told = {"success": True, "rows": r.meta["rows"], "overall": r.quality.overall}
        except Exception as e:  # recorded: one question's failure doesn't stop the batch
            told = {"success": False, "error": str(e)[:500]}
        out.append({"question": question, **told, "seconds": round(time.monotonic() - began, 3)})
    return out


def batch_summary(results: list[dict]) -> dict:
    good = sum(r["success"] for r in results)
    return {"total": len(results), "success": good, "failed": len(results) - good, "average_seconds": sum(r["seconds"] for r in results) / max(1, len(results))}
