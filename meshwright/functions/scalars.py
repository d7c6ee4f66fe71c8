"""Column expressions for dirty text: what counts as missing, as a number, as a date or as a truth value.

All stay in the JVM, none fails under ANSI mode: what doesn't fit becomes null."""

from __future__ import annotations

import re

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Vocabularies and formats that results depend on.
TRUE_WORDS = ["true", "yes", "1", "t", "y"]
FALSE_WORDS = ["false", "no", "0", "f", "n"]
INGEST_NULLS = ["--", "-", "", "NA", "N/A", "null", "None"]
UPLOAD_NULLS = ["", "NA", "NaN", "N/A", "null", "None", "\\N", "nan", "Null"]
DATE_FORMATS = ["yyyy-M-d", "M/d/yyyy", "yyyyMMdd"]
NUMBER = r"^-?\d+(\.\d+)?$"
LOOSE_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
CATEGORIES = [
    ("action", ["action"]), ("comedy", ["comedy"]), ("drama", ["drama"]), ("thriller", ["thriller"]), ("horror", ["horror"]), ("romance", ["romance"]),
    ("sci-fi", ["science fiction", "sci-fi", "scifi"]), ("documentary", ["documentary"]), ("animation", ["animated", "animation"]),
    ("company", ["company", "corporation", "firm"]), ("movie", ["film", "movie"]), ("series", ["television series", "tv series", "series"]),
]


def col(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def text_of(c: Column) -> Column:
    return c.cast("string")


def strip(c: Column) -> Column:
    return F.regexp_replace(text_of(c), r"^\s+|\s+$", "")


def is_missing(c: Column) -> Column:
    """Null or blank."""
    return c.isNull() | (strip(c) == "")


def is_usable(c: Column) -> Column:
    """Neither null nor "" nor the word None."""
    return F.coalesce(~text_of(c).isin("", "None"), F.lit(False))


def known_nulls(c: Column, words: list[str]) -> Column:
    return F.when(~c.isin(words), c)


def looks_numeric(c: Column) -> Column:
    return F.coalesce(F.regexp_replace(strip(c), ",", "").rlike(NUMBER), F.lit(False))


def is_numeric_ratio_hit(c: Column) -> Column:
    return F.coalesce(F.regexp_replace(strip(c), ",", ".").rlike(NUMBER), F.lit(False))


def in_range(c: Column, low: float, high: float) -> Column:
    return F.coalesce(text_of(c).try_cast("double").between(low, high), F.lit(False))


def _bare(c: Column) -> Column:
    return F.regexp_replace(strip(c), r"[,$€£¥]", "")


def to_number(c: Column) -> Column:
    """Strict decimal literal after dropping thousands commas and currency signs."""
    return F.when(_bare(c).rlike(NUMBER), _bare(c).try_cast("double"))


def to_number_loose(c: Column) -> Column:
    """As to_number, and exponents count too."""
    return F.when(_bare(c).rlike(LOOSE_NUMBER), _bare(c).try_cast("double"))


def _shape(date_format: str) -> str | None:
    """A pattern that every text of a numeric date format has; None for a format with other letters."""
    runs = re.findall(r"y+|M+|d+|[^A-Za-z']", date_format)
    if "".join(runs) != date_format or "MMM" in date_format:
        return None
    digits = {"y": lambda n: r"[+-]?\d{1,}" if n != 2 else r"\d{2}", "M": lambda n: r"\d{1,2}", "d": lambda n: r"\d{1,2}"}
    return "^" + "".join(digits[r[0]](len(r)) if r[0] in digits else re.escape(r) for r in runs) + "$"


def to_date_text(c: Column, formats: list[str] | None = None) -> Column:
    """ISO text of the first format that parses. A text that can't have a format's shape isn't parsed: a failed parse costs
    an exception."""
    text = strip(c)
    parse = lambda f: F.try_to_date(text, f) if _shape(f) is None else F.when(text.rlike(_shape(f)), F.try_to_date(text, f))
    tries = [parse(f) for f in formats or DATE_FORMATS]
    return F.date_format(F.coalesce(*tries), "yyyy-MM-dd")


def to_date_digits(c: Column) -> Column:
    """Year-month-day, or month/day/year, at the text's start: as yyyy-MM-dd with padded parts, whatever the calendar says."""
    text = strip(c)
    part = lambda p, k, n: F.lpad(F.regexp_replace(F.regexp_extract(text, p, k), r"^0+(?=\d)", ""), n, "0")
    year = lambda p, k: F.regexp_replace(F.regexp_extract(text, p, k), r"^0+(?=\d)", "")
    iso, us = r"^(\d{4})-(\d{1,2})-(\d{1,2})", r"^(\d{1,2})/(\d{1,2})/(\d{4})"
    return F.when(text.rlike(iso), F.concat_ws("-", year(iso, 1), part(iso, 2, 2), part(iso, 3, 2))).when(
        text.rlike(us), F.concat_ws("-", year(us, 3), part(us, 1, 2), part(us, 2, 2))
    )


def to_bool(c: Column, trim: bool = True) -> Column:
    low = F.lower(strip(c) if trim else text_of(c))
    return F.when(low.isin(TRUE_WORDS), F.lit(True)).when(low.isin(FALSE_WORDS), F.lit(False))


def first_year(c: Column) -> Column:
    return F.nullif(F.regexp_extract(text_of(c), r"\b(19\d{2}|20\d{2})\b", 1), F.lit("")).cast("int")


def keyword_category(c: Column) -> Column:
    """The first category, in the fixed order, of which the text has a keyword."""
    low = F.lower(text_of(c))
    rules = [(name, reduce(lambda a, b: a | b, [low.contains(w) for w in words])) for name, words in CATEGORIES]
    head, *tail = rules
    return reduce(lambda acc, r: acc.when(r[1], F.lit(r[0])), tail, F.when(head[1], F.lit(head[0])))


def is_a_phrase(c: Column) -> Column:
    """What the text says it is: 2 to 60 characters after "is a" or "was a", from a letter to a punctuation mark."""
    got = F.regexp_extract(text_of(c), r"(?i)\b(?:is|was)\s+an?\s+([a-z][a-z\s\-]{1,59}?)(?:[.,;(]|\s+(?:that|which|who|based|directed|founded|in|by|from)\b|$)", 1)
    return F.nullif(F.lower(strip(got)), F.lit(""))


def money(c: Column) -> Column:
    """"$1,234" or "142 min" as a number; N/A as null."""
    return F.nullif(F.regexp_extract(F.regexp_replace(text_of(c), r"[$,]", ""), r"^\s*(-?\d+(?:\.\d+)?)", 1), F.lit("")).try_cast("double")


def squeezed(c: Column) -> Column:
    return F.regexp_replace(strip(c), r"\s+", " ")


def name_key(c: Column) -> Column:
    """Entity names compare by this."""
    return F.lower(squeezed(c))


def levenshtein_ratio(a: Column, b: Column) -> Column:
    """1 - distance / longer length of the lower-cased texts; two empty texts are equal."""
    x, y = F.lower(text_of(a)), F.lower(text_of(b))
    longest = F.greatest(F.length(x), F.length(y))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(x, y) / longest)


def values_agree(a: Column, b: Column, tolerance: float = 0.01) -> Column:
    """Equal ignoring case, or numbers less than the tolerance apart once commas and dollar signs are gone; nulls agree."""
    x, y = F.regexp_replace(strip(a), r"[,$]", ""), F.regexp_replace(strip(b), r"[,$]", "")
    number = lambda v: F.when(v.rlike(LOOSE_NUMBER), v.try_cast("double"))
    close = F.abs(number(x) - number(y)) < tolerance
    same = (F.lower(strip(a)) == F.lower(strip(b))) | F.coalesce(close, F.lit(False))
    return F.when(a.isNull() & b.isNull(), F.lit(True)).when(a.isNull() | b.isNull(), F.lit(False)).otherwise(same)


def texts_agree(a: Column, b: Column) -> Column:
    """Nulls agree; equal when trimmed and lower-cased; same year if both hold one; one long text within the other."""
    x, y = F.lower(strip(a)), F.lower(strip(b))
    years = first_year(a) == first_year(b)
    within = (F.length(x) > 20) & (F.length(y) > 20) & (x.contains(y) | y.contains(x))
    both_years = first_year(a).isNotNull() & first_year(b).isNotNull()
    return (
        F.when(a.isNull() & b.isNull(), F.lit(True)).when(a.isNull() | b.isNull(), F.lit(False)).when(x == y, F.lit(True))
        .when(both_years, years).otherwise(within)
    )
