"""Cleaning with an audit log: a profile decides a rule for each column, one projection applies all rules, and the log
compares before and after. Never adds or drops rows or columns, never touches keys."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meshwright.functions import profile as p
from meshwright.functions import scalars as s
from meshwright.functions.iterate import cut

DATE_WORDS = ("date", "time", "year", "month", "day", "created", "updated")


@dataclass(frozen=True)
class Rule:
    """A new value for a column, and the reason for a change as an expression of the old and the new value."""

    new: Callable[[Column], Column]
    reason: Callable[[Column, Column], Column]


def _fixed(what: str, done: str) -> Callable[[Column, Column], Column]:
    return lambda old, new: F.when(new.isNull(), F.lit(f"Type fix: invalid {what} value")).otherwise(F.lit(done))


def numeric_rule(parse: Callable[[Column], Column] = s.to_number) -> Rule:
    return Rule(parse, _fixed("numeric", "Type fix: converted to numeric"))


def date_rule(formats: list[str] | None = None) -> Rule:
    return Rule(lambda c: s.to_date_text(c, formats), _fixed("date", "Format fix: standardized date"))


def date_digits_rule() -> Rule:
    """Pads numeric dates; a value of no such shape stays."""
    return Rule(lambda c: F.coalesce(s.to_date_digits(c), s.text_of(c)), lambda old, new: F.lit("Format standardization: date"))


def bool_rule(trim: bool = True) -> Rule:
    return Rule(lambda c: s.to_bool(c, trim), _fixed("boolean", "Type fix: converted to boolean"))


def text_rule(lower: bool) -> Rule:
    if not lower:
        return Rule(s.strip, lambda old, new: F.lit("Format fix: removed whitespace"))
    case = lambda old, new: F.when(s.strip(old) != new, F.lit("Format fix: standardized case")).otherwise(F.lit("Format fix: removed whitespace"))
    return Rule(lambda c: F.lower(s.strip(c)), case)


def is_numeric_column(c: p.ColumnProfile) -> bool:
    return c.is_numeric or c.is_text and c.numeric > 0.8


def is_date_column(c: p.ColumnProfile) -> bool:
    return isinstance(c.dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)) or any(w in c.name.lower() for w in DATE_WORDS)


def is_bool_column(c: p.ColumnProfile) -> bool:
    return isinstance(c.dtype, T.BooleanType) or 0 < c.present_distinct <= 2 and c.booleans == 0


def type_rules(seen: dict[str, p.ColumnProfile]) -> dict[str, Rule]:
    """Numeric, then date, then boolean: the first that applies to a column that isn't of that type already."""
    out: dict[str, Rule] = {}
    for n, c in seen.items():
        if is_numeric_column(c):
            if not c.is_numeric:
                out[n] = numeric_rule()
        elif is_date_column(c):
            if c.is_text:
                out[n] = date_rule()
        elif is_bool_column(c) and c.is_text:
            out[n] = bool_rule()
    return out


def needs_fast(c: p.ColumnProfile) -> bool:
    few = 2 <= c.distinct <= 20
    return c.null_rate > 0.5 or is_numeric_column(c) and c.unnumbered > 0 or c.is_text and (c.padded > 0 or few and c.lowered < c.present_distinct)


def fast_rules(seen: dict[str, p.ColumnProfile]) -> dict[str, Rule]:
    """Numeric, then text (lower-cased where 2 to 20 values), then date, then boolean, for columns that need it."""
    out: dict[str, Rule] = {}
    for n, c in seen.items():
        if not needs_fast(c):
            continue
        if is_numeric_column(c):
            if not c.is_numeric:
                out[n] = numeric_rule(s.to_number_loose)
        elif c.is_text:
            out[n] = text_rule(2 <= c.distinct <= 20)
        elif is_date_column(c):
            out[n] = date_rule(["yyyy-MM-dd"])
        elif is_bool_column(c):
            out[n] = bool_rule(trim=False)
    return out


def outlier_rule(low: float, high: float) -> Rule:
    def new(c: Column) -> Column:
        v = c.try_cast("double")
        return F.when((v < low) | (v > high), F.lit(None)).otherwise(c)

    return Rule(new, lambda old, new: F.lit("Outlier fix: removed outlier"))


def updatable_columns(df: DataFrame, keys: list[str]) -> list[str]:
    """The columns other than keys with a null or an empty text, by one aggregation."""
    names = [c for c in df.columns if c not in keys]
    if not names:
        return []
    row = df.agg(*(F.coalesce(F.max(s.text_of(s.col(c)).isNull() | (s.text_of(s.col(c)) == "")), F.lit(False)).alias(f"m{k}") for k, c in enumerate(names))).first()
    return [c for c, some in zip(names, row, strict=True) if some]


@dataclass
class CleaningReport:
    cleaned_cells: int = 0
    cleaned_rows: int = 0
    cleaned_columns: list[str] = field(default_factory=list)
    type_fixes: int = 0
    format_fixes: int = 0
    outlier_fixes: int = 0
    duplicate_fixes: int = 0
    errors: list[str] = field(default_factory=list)


def apply_rules(df: DataFrame, rules: dict[str, Rule], keys: list[str]) -> DataFrame:
    """All rules in one projection."""
    return df.select(*(rules[c].new(s.col(c)).alias(c) if c in rules and c not in keys else s.col(c) for c in df.columns))


def changes_of(df: DataFrame, rules: dict[str, Rule], keys: list[str], row: str | None = None) -> DataFrame:
    """(row_index?, keys, column, before, after, reason): one row a changed cell. Every new value is computed once, in a
    projection of its own; only changed cells are unpivoted."""
    used = {c: rule for c, rule in rules.items() if c not in keys and c in df.columns}
    lead = [s.col(row).alias("row_index")] if row else []
    told = df.select(*lead, *(s.col(k) for k in keys), *(s.col(c).alias(f"__old{i}") for i, c in enumerate(used)), *(rule.new(s.col(c)).alias(f"__new{i}") for i, (c, rule) in enumerate(used.items())))
    cells = []
    for i, (c, rule) in enumerate(used.items()):
        old, new = F.col(f"__old{i}"), F.col(f"__new{i}")
        before, after = s.text_of(old), s.text_of(new)
        entry = F.struct(F.lit(c).alias("column"), before.alias("before"), after.alias("after"), rule.reason(old, new).alias("reason"))
        cells.append(F.when(~before.eqNullSafe(after), entry))
    schema = "array<struct<column:string,before:string,after:string,reason:string>>"
    packed = F.array_compact(F.array(*cells)) if cells else F.array().cast(schema)
    head = [*(["row_index"] if row else []), *(s.col(k) for k in keys)]
    return told.select(*head, packed.alias("__c")).where(F.size("__c") > 0).select(*head, F.inline("__c"))


def report_frame(changes: DataFrame, row: list[str]) -> DataFrame:
    """A single row; a reason may count under several heads."""
    low = F.lower(F.col("reason"))
    count = lambda w: F.coalesce(F.sum(low.contains(w).cast("long")), F.lit(0)).alias(f"{w}_fixes")
    return changes.agg(
        F.count(F.lit(1)).alias("cleaned_cells"), F.count_distinct(F.struct(*(s.col(c) for c in row))).alias("cleaned_rows"),
        F.concat_ws(",", F.sort_array(F.collect_set("column"))).alias("cleaned_columns"), *(count(w) for w in ("type", "format", "outlier", "duplicate")),
    )


def report_of(changes: DataFrame, row: list[str]) -> CleaningReport:
    r = report_frame(changes, row).first()
    return CleaningReport(r.cleaned_cells, r.cleaned_rows, [c for c in r.cleaned_columns.split(",") if c], r.type_fixes, r.format_fixes, r.outlier_fixes, r.duplicate_fixes)


# --- value dictionaries ------------------------------------------------------------------------------------------------


def dictionary_key(column: Column | str, raw: Column, version: str = "v1") -> Column:
    return F.sha2(F.concat_ws("‖", F.lit(version), F.lit(column) if isinstance(column, str) else column, raw), 256)


def suspicious_columns(seen: dict[str, p.ColumnProfile], keys: list[str]) -> list[str]:
    def odd(c: p.ColumnProfile) -> bool:
        return c.unique_rate > 0.02 and c.punctuation > 0.02 or c.unique_rate > 0.2 or c.null_rate > 0.2 and c.unique_rate > 0.01

    return [n for n, c in seen.items() if n not in keys and not c.is_numeric and not isinstance(c.dtype, T.BooleanType) and odd(c)]


def complex_columns(seen: dict[str, p.ColumnProfile], keys: list[str], done: set[str] = frozenset(), outliers: dict[str, float] | None = None) -> list[str]:
    """What rules leave to an advisor."""

    def simple(n: str, c: p.ColumnProfile) -> bool:
        return (
            n in keys or n in done or c.unique_rate > 0.95 or c.distinct < 10 and c.null_rate < 0.3 or c.null_rate > 0.8
            or c.is_numeric and (outliers or {}).get(n, 0.0) < 0.02 or is_date_column(c) and not c.is_text
        )

    return [n for n, c in seen.items() if not simple(n, c)]


def standard_values(df: DataFrame, column: str, budget: int | None = None) -> DataFrame:
    """(raw, cleaned): white space squeezed, and of spellings that differ in case the most frequent one. A budget keeps
    the most frequent raw values only, as a report does; default is all."""
    freq = p.value_frequency(df, column, budget)
    folded = freq.select(F.col("value").alias("raw"), s.squeezed(F.col("value")).alias("tidy"), "n")
    best = folded.groupBy(F.lower("tidy").alias("fold"), "tidy").agg(F.sum("n").alias("n")).groupBy("fold").agg(F.max_by("tidy", F.struct("n", "tidy")).alias("cleaned"))
    return folded.join(best, F.lower("tidy") == F.col("fold")).where("raw <> cleaned").select("raw", "cleaned")


def apply_dictionary(df: DataFrame, column: str, mapping: DataFrame) -> DataFrame:
    """Left join on the raw value; a value without an entry stays. Spark broadcasts the dictionary where it is small."""
    m = mapping.select(F.col("raw").alias("__raw"), F.col("cleaned").alias("__cleaned"))
    joined = df.join(m, s.text_of(s.col(column)) == F.col("__raw"), "left")
    return joined.select(*(F.coalesce("__cleaned", s.col(c)).alias(c) if c == column else s.col(c) for c in df.columns))


def similar_values(values: DataFrame, least: float = 0.9) -> DataFrame:
    """(value, representative): values whose similarity reaches `least`, joined to components; the most frequent value
    represents. values: (value, n).

    No pair is lost: a text within k edits of one of length L holds one of its k + 1 segments unchanged, moved by at most
    k places. So values are joined by (length, L, segment number, segment) before they are compared."""
    from meshwright.functions.iterate import components

    v = cut(values.select("value", "n").withColumn("id", F.monotonically_increasing_id()))
    keyed = v.select("id", "value", F.lower("value").alias("low")).where("low is not null").withColumn("size", F.length("low"))
    edits, start, end = f"cast(floor((1 - {least}D) * long + 1e-9) as int)", "cast(floor(seg * short / (k + 1)) as int)", "cast(floor((seg + 1) * short / (k + 1)) as int)"

    def segments(rows: DataFrame) -> DataFrame:
        return rows.withColumn("k", F.expr(edits)).withColumn("seg", F.explode(F.expr("sequence(0, k)"))).withColumns({"from": F.expr(start), "to": F.expr(end)})

    whole = keyed.withColumnRenamed("size", "short").withColumn("long", F.explode(F.expr(f"sequence(short, cast(floor(short / {least}D + 1e-9) as int))")))
    whole = segments(whole).select("short", "long", "seg", F.expr("substring(low, `from` + 1, `to` - `from`)").alias("part"), F.col("id").alias("b"), F.col("value").alias("vb"))
    probe = keyed.withColumnRenamed("size", "long").withColumn("short", F.explode(F.expr(f"sequence(cast(ceil({least}D * long - 1e-9) as int), long)")))
    probe = segments(probe).withColumn("at", F.explode(F.expr("sequence(`from` - k, `from` + k)"))).where("at >= 0 and at + `to` - `from` <= long")
    probe = probe.select("short", "long", "seg", F.expr("substring(low, at + 1, `to` - `from`)").alias("part"), "id", "value")
    met = probe.join(whole, ["short", "long", "seg", "part"]).where("id <> b").select("id", "value", "b", "vb").distinct()
    links = met.where(s.levenshtein_ratio(F.col("value"), F.col("vb")) >= least).select(F.col("id").alias("a"), "b")
    label = components(links)
    told = v.join(label, "id", "left").withColumn("label", F.coalesce("label", "id"))
    best = told.groupBy("label").agg(F.max_by("value", F.struct("n", "value")).alias("representative"))
    return told.join(best, "label").select("value", "representative")


# --- modes -------------------------------------------------------------------------------------------------------------


def _outlier_rules(df: DataFrame, seen: dict[str, p.ColumnProfile], keys: list[str], approximate: bool) -> dict[str, Rule]:
    out = {}
    for n, c in seen.items():
        if c.is_numeric and n not in keys:
            b = p.iqr_bounds(df, n, approximate=approximate).first()
            if b.low is not None:
                out[n] = outlier_rule(b.low, b.high)
    return out


def clean_data(
    df: DataFrame, keys: list[str], mode: str = "fast", advisor=None, rules: dict | None = None, row: str | None = None, approximate: bool | None = None
) -> tuple[DataFrame, DataFrame, CleaningReport]:
    """(cleaned, changes, report). Modes: fast; type or minimal; hybrid, batch, llm, comprehensive and ultra (also hyper,
    turbo), which ask an advisor; without one ultra and hybrid act as fast, the others as type.

    A dictionary of the ultra modes holds the most frequent values, as many as `dictionary_budget` says; rules={"budget":
    False} takes all values."""
    known = {"ultra", "hyper", "turbo", "fast", "hybrid", "batch", "comprehensive", "llm", "type", "minimal"}
    if mode not in known:
        raise ValueError(f"unknown cleaning mode: {mode}")
    if advisor is None:
        mode = "fast" if mode in ("ultra", "hyper", "turbo", "hybrid", "fast") else "type"
    seen = p.profile(df, [c for c in df.columns if c not in keys and c != row], approximate)
    chosen = fast_rules(seen) if mode in ("fast", "hybrid", "ultra", "hyper", "turbo") else type_rules(seen)
    if advisor is not None and mode in ("hybrid", "batch", "llm", "comprehensive"):
        for n in complex_columns(seen, keys, set(chosen)):
            if (plan := advisor.cleaning_plan(seen[n])) == "outliers":
                chosen |= _outlier_rules(df, {n: seen[n]}, keys, bool(approximate))
            elif plan == "numeric":
                chosen[n] = numeric_rule()
            elif plan == "date":
                chosen[n] = date_rule()
    out, changes = apply_rules(df, chosen, keys), changes_of(df, chosen, keys, row)
    if advisor is not None and mode in ("ultra", "hyper", "turbo"):
        for n in suspicious_columns(seen, keys):
            if n not in chosen or out.schema[n].dataType == T.StringType():
                budget = p.dictionary_budget(seen[n].distinct) if (rules or {}).get("budget", True) else None
                m = cut(advisor.value_dictionary(out, n, budget))  # both the values and their log read it
                before, out = out, apply_dictionary(out, n, m)
                told = before.join(m, s.text_of(s.col(n)) == F.col("raw")).select(
                    *([s.col(row).alias("row_index")] if row else []), *(s.col(k) for k in keys), F.lit(n).alias("column"), F.col("raw").alias("before"), F.col("cleaned").alias("after"), F.lit("Format fix: value dictionary").alias("reason")
                )
                changes = changes.unionByName(told)
    return out, changes, report_of(changes, ["row_index"] if row else keys)


Cleaner = Callable[[DataFrame], tuple[DataFrame, DataFrame, CleaningReport]]


def clean_in_turn(df: DataFrame, cleaners: dict[str, Cleaner], row: list[str]) -> tuple[DataFrame, DataFrame | None, CleaningReport]:
    """Composite: each cleaner works on what the one before left, and their change logs are joined. A cleaner that fails is
    left out and named in the report's errors."""
    changes, errors = None, []
    for name, run in cleaners.items():
        try:
            df, told, _ = run(df)
        except Exception as e:  # the others go on
            errors.append(f"{name}: {type(e).__name__}: {e}")
            continue
        changes = told if changes is None else changes.unionByName(told)
    report = report_of(changes, row) if changes is not None else CleaningReport()
    report.errors = errors
    return df, changes, report
