"""Reading a plain-language request: wanted columns, domain, topic, and the bullets of an advisor's answer."""

from __future__ import annotations

import json
import re
from typing import Any

# Fixed values.
FILE_STOPWORDS = {"dataset", "data", "file", "table", "model", "train", "test", "csv", "json"}
TOPIC_STOPWORDS = {"need", "with", "and", "the", "a", "an", "please", "help", "dataset", "database"}
DOMAIN_SKIP = {"the", "a", "an", "with", "for", "about", "find", "get", "show", "list", "all", "data", "dataset", "table"}
DOMAIN_WORDS = {
    "movie": "movie film director actor imdb runtime genre box_office cinema tmdb release".split(),
    "stock": "stock ticker equity ohlc close open volume exchange nasdaq nyse price".split(),
    "ecommerce": "product sku order cart quantity price customer ecommerce retail basket".split(),
    "paper": "paper author conference journal citation abstract publication doi".split(),
}


LIST_MARKS = ("包含", "需要", "字段为", "列为")
LIST_JOINERS = ("and", "with")
BREAKS = str.maketrans(dict.fromkeys(",，、/|;", "\n"))
_WORD = re.compile(r"[A-Za-z0-9_]+")


def requested_columns(question: str | None) -> list[str]:
    """The snake-case names after "with" (or its Chinese counterparts), in order, once each."""
    text = question or ""
    start = next((m.end() for m in _WORD.finditer(text) if m[0].lower() == "with"), None)
    if start is None:
        start = min((text.index(x) + len(x) for x in LIST_MARKS if x in text), default=len(text))
    names: list[str] = []
    for item in text[start:].translate(BREAKS).split("\n"):
        words: list[str] = []
        for w in [*_WORD.findall(item), LIST_JOINERS[0]]:  # a joiner closes a name, and so does the item's end
            if w.lower() not in LIST_JOINERS:
                words.append(w)
                continue
            names.append("_".join(words).strip("_").lower())
            words = []
    return [n for n in dict.fromkeys(names) if len(n) > 1]


def domain_keyword(question: str | None) -> str | None:
    """The word before the word "database", with nothing but spaces, hyphens or underscores between; else what stands
    before its Chinese counterpart."""
    text = question or ""
    words = list(re.finditer(r"[A-Za-z0-9]+", text))
    for before, word in zip(words, words[1:], strict=False):
        gap = text[before.end() : word.start()]
        if word[0].lower() == "database" and gap[-1:].isspace() and not gap.strip(" \t\r\n_-"):
            return before[0].lower()
    head, mark, _ = text.partition("数据库")
    size = 0
    while mark and size < min(30, len(head)) and (_WORD.fullmatch(head[-1 - size]) or "一" <= head[-1 - size] <= "龥"):
        size += 1
    return head[len(head) - size :].lower() or None if mark else None


def topic_keyword(question: str) -> str | None:
    if m := re.search(r"(\w+)\s+database", question, re.I):
        return m[1].lower()
    return next((w for w in re.findall(r"[a-z0-9_]+", question.lower()) if w not in TOPIC_STOPWORDS), None)


def file_tokens(question: str) -> list[str]:
    return [w for w in re.findall(r"[a-z0-9]+", question.lower()) if len(w) >= 3 and w not in FILE_STOPWORDS]


def detect_domain(columns: list[str], question: str = "") -> str:
    body = " ".join([*columns, question]).lower()
    return next((d for d, words in DOMAIN_WORDS.items() if any(w in body for w in words)), "generic")


def entity_domain(columns: list[str], question: str = "") -> str:
    """From a column such as movie_title, else the question's first telling word in the singular, else entity."""
    for c in columns:
        m = re.fullmatch(r"(.+)_(?:title|name|id|code)", c.lower())
        if m and len(m[1]) > 2:
            return m[1]
    for w in re.findall(r"[a-z]+", question.lower()):
        if len(w) > 3 and w not in DOMAIN_SKIP:
            return w[:-1] if w.endswith("s") else w
    return "entity"


def entity_type(keys: list[str], columns: list[str]) -> str:
    for c in [*keys[:1], *columns]:
        if (m := re.fullmatch(r"(.+?)_(?:id|name|title|code|key)", c.lower())):
            return m[1]
    return "entity"


def parse_mapping(text: str) -> dict[str, str]:
    """{feature: source} from bullets "- feature → source (index = 2)"; sources "none" are dropped."""
    out = {}
    for line in text.splitlines():
        m = re.match(r"[\s\-•*]*([\w .\-/]+?)\s*(?:→|->|:)\s*([^(\n]+)", line.strip())
        if m and m[2].strip().lower() != "none":
            out[m[1].strip()] = m[2].strip()
    return out


def parse_keys(text: str) -> list[str]:
    found = (re.match(r"[\s\-•*]*([\w.\-/]+)", line) for line in text.splitlines())
    return [m[1] for m in found if m and m[1].lower() != "none"]


def lenient_json(text: str) -> Any:
    """The JSON in a chatty answer: all of it, a fenced block, or the first balanced object or list; None if there is none."""
    tries = [text, *re.findall(r"```(?:json)?\s*(.+?)```", text, re.S)]
    tries += [text[text.index(a) : text.rindex(b) + 1] for a, b in ("{}", "[]") if a in text and b in text[text.index(a) :]]
    for t in tries:
        try:
            return json.loads(t)
        except ValueError:
            continue
    return None


def same_entity_answer(text: str) -> tuple[bool, float]:
    got = lenient_json(text)
    if isinstance(got, dict):
        return bool(got.get("same", False)), float(got.get("confidence", 0.0))
    return (bool(re.search(r"\b(?:yes|true|same)\b", text, re.I)) and not re.search(r"\bnot\b", text, re.I)), 0.0
