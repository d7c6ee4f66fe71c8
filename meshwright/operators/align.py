"""Schema alignment: mapping sources to requested features, scoring headers, unifying types."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meshwright.functions import scalars as s
from meshwright.functions.profile import ColumnProfile, profile

TEMPORAL = (T.DateType, T.TimestampType, T.TimestampNTZType, T.DayTimeIntervalType)


def unified_type(types: Iterable[T.DataType]) -> T.DataType:
    """One type for a column of several files; nulls have no say. Any text wins, then any number as double."""
    seen = [t for t in types if not isinstance(t, T.NullType)]
    if not seen or any(isinstance(t, T.StringType | T.BinaryType) for t in seen):
        return T.StringType()
    if any(isinstance(t, T.NumericType) for t in seen):
        return T.DoubleType()
    first = seen[0]
    if isinstance(first, (T.BooleanType, *TEMPORAL)) and all(t == first for t in seen):
        return first
    return T.StringType()


def lenient_cast(df: DataFrame, schema: dict[str, T.DataType]) -> DataFrame:
    """The named columns in that order; a missing column or a value that can't be cast is null."""
    have = {f.name: f.dataType for f in df.schema}

    def one(name: str, to: T.DataType):
        if name not in have:
            return F.lit(None).cast(to).alias(name)
        c = s.col(name)
        if have[name] == to:
            return c
        if isinstance(have[name], T.StringType) and isinstance(to, T.NumericType):  # Java takes "5d" for a number
            return F.when(s.strip(c).rlike(s.LOOSE_NUMBER), c.try_cast(to)).alias(name)
        return c.try_cast(to).alias(name)

    return df.select(*(one(n, t) for n, t in schema.items()))


def union_unified(frames: list[DataFrame], columns: list[str] | None = None) -> DataFrame:
    """All rows of all frames over the union of their columns, each of one unified type."""
    names = columns or list(dict.fromkeys(n for f in frames for n in f.columns))
    kinds = {n: unified_type(f.schema[n].dataType for f in frames if n in f.columns) for n in names}
    out = lenient_cast(frames[0], kinds)
    for f in frames[1:]:
        out = out.unionByName(lenient_cast(f, kinds))
    return out


def rename(df: DataFrame, mapping: dict[str, str], passthrough: Iterable[str] = (), keep_unused: bool = True) -> DataFrame:
    """mapping is {feature: source}; a source may be written with notes, as in "col (index 2)" or "file|col"."""
    picked: dict[str, str] = {}
    for feature, source in mapping.items():
        found = source_name(source, df.columns)
        if found is not None and feature not in picked:
            picked[feature] = found
    rest = [c for c in passthrough if c in df.columns]
    if keep_unused:
        rest += [c for c in df.columns if c not in picked.values()]
    names = list(dict.fromkeys([*picked, *rest]))
    return df.select(*(s.col(picked.get(n, n)).alias(n) for n in names))


def source_name(written: str | None, columns: list[str]) -> str | None:
    if written is None or written.strip().lower() in ("", "none"):
        return None
    bare = re.sub(r"\s*\(index.*$", "", written).strip()
    for name in (bare, *(bare.rsplit(mark, 1)[-1].strip() for mark in "|,")):
        if name in columns:
            return name
    return None


def plain(name: str) -> str:
    return re.sub(r"[\s_\-]+", "", name).lower()


def mapping_by_name(columns: list[str], features: list[str]) -> dict[str, str]:
    by = {plain(c): c for c in reversed(columns)}
    return {f: by[plain(f)] for f in features if plain(f) in by}


def header_score(header: str, wanted: str, topic: str | None, values: ColumnProfile | None = None) -> float:
    """How well a header (and, with a profile, its values) serves a wanted feature. The weights are fixed values."""
    h, f = _token(header), _token(wanted)
    t = _token(topic) if topic else ""
    score = 0.3 * max(0, 8 - len(h))
    if f:
        score += 15 if h == f else 8 if f in h else 0
        score += 3 if h.startswith(f) else 0
    if t:
        has = t in h
        score += 6 * has
        score += 15 * bool(re.search(f"{re.escape(t)}[_-]*{re.escape(f)}", h)) + 10 * bool(re.search(f"{re.escape(f)}[_-]*{re.escape(t)}", h))
        score += 8 * (has and f in h)
    if values:
        score += 5 * values.numeric
        score += 6 if values.unique_rate > 0.8 and values.numeric > 0.5 else 2 if values.unique_rate > 0.3 else 0
        score += 5 * bool(t and t in h and values.numeric > 0.5)
    return float(score)


def _token(name: str) -> str:
    return re.sub(r"[^a-z0-9_]+", "_", name.strip().lower())


def best_header(columns: list[str], wanted: str, topic: str | None, profiles: dict[str, ColumnProfile] | None = None) -> str | None:
    """The header of the highest score, if that is high enough. An id under a topic prefers a header with the topic."""
    ranked = sorted(((header_score(c, wanted, topic, (profiles or {}).get(c)), -i, c) for i, c in enumerate(columns)), reverse=True)
    careful = _token(wanted) == "id" and bool(topic)
    if not ranked or ranked[0][0] < (4.0 if careful else 2.5):
        return None
    if careful and len(ranked) > 1:
        topical = [_token(topic) in _token(r[2]) for r in ranked[:2]]
        if topical == [False, True] and ranked[0][0] - ranked[1][0] <= 8:
            return ranked[1][2]
    return ranked[0][2]


def requested_subset(df: DataFrame, wanted: list[str], topic: str | None = None, least: float = 0.02) -> DataFrame | None:
    """The wanted columns by best header, null where none serves; None unless a column other than an id has enough
    usable values."""
    seen = profile(df)
    picks = {w: best_header(df.columns, w, topic, seen) for w in wanted}
    is_id = lambda w: "id" in re.split(r"[\s_\-]+", w.lower())
    if not any(h and not is_id(w) and seen[h].usable >= least for w, h in picks.items()):
        return None
    return df.select(*((s.col(h) if h else F.lit(None).cast("string")).alias(w) for w, h in picks.items()))


def union_distinct(frames: list[DataFrame], columns: list[str]) -> DataFrame:
    return union_unified(frames, columns).dropDuplicates(columns)


def project(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns in canonical order; absent ones as null text."""
    return df.select(*((s.col(c) if c in df.columns else F.lit(None).cast("string").alias(c)) for c in columns))


def name_score(header: str, wanted: str, domain: str | None = None) -> int:
    """How well a header fits by names alone. Fixed weights: equal 50; the domain as a part 20; domain and feature both in it
    30; domain then feature 40; feature then domain 25; prefix 5; contained 2; ten less its length for a short one."""
    h, w, d = (re.sub(r"[^a-z0-9]+", "_", (x or "").lower()).strip("_") for x in (header, wanted, domain))
    parts = lambda x, y: bool(re.search(rf"(?:^|_){re.escape(x)}_*{re.escape(y)}(?:_|$)", h))
    score = 50 * (h == w) + 5 * h.startswith(w) + 2 * (w in h) + max(0, 10 - len(h))
    if d:
        score += 20 * parts(d, "") + 30 * (d in h and w in h) + 40 * parts(d, w) + 25 * parts(w, d)
    return score


def best_names(headers: list[str], wanted: list[str], domain: str | None = None) -> dict[str, str | None]:
    """For each wanted name the header of the highest score; of equal ones the first."""
    return {w: max(headers, key=lambda h: name_score(h, w, domain), default=None) for w in wanted}
