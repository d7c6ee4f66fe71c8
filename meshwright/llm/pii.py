"""Personal data by weak supervision.

Base detectors (email, ip, card, phone) find their spans alone, and those spans always stay. Further candidates
(secrets, numbers, names) are judged: regex, gazetteer and context labelers each vote for, against or not at all, and
what the corpus holds of every vote pattern is counted over all whole texts. Dawid-Skene expectation-maximisation over
those counts (a table of at most 3**6 patterns a kind) estimates each labeler's reliability in each kind and the
patterns' posteriors; on them a logistic span classifier over one-hot votes and shapes is trained, weighted by the
counts. It gives the final verdict on every candidate.

Long runs can't make a detector quadratic: digit runs are matched possessively, and an email is found from its @ sign.

Defined cases: a null text is empty and has no spans; an empty table gives no rows; spans of different kinds may overlap,
those of one kind don't; repeated rows and null keys are documents of their own; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwright.llm._text import cut, small_batches

KINDS = ("email", "ip", "card", "phone")
MORE = ("secret", "number", "name")
ORDER = {k: i for i, k in enumerate(KINDS + MORE)}

_AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGIT = re.compile(r"[0-9]")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_SECRET = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+=*")
_NUMBER = re.compile(r"(?<![A-Za-z0-9.+])\(?[0-9](?:[ ()./-]{0,2}[0-9]){6,14}+(?![A-Za-z0-9])")
_NAME = re.compile(r"(?<![^\W\d_])[A-ZÀ-Þ][a-zß-ÿ]+(?: [A-ZÀ-Þ][a-zß-ÿ]+){1,2}+(?![^\W\d_])")

# Gazetteers and context words: fixed values of this operator.
FIRST_NAMES = frozenset(
    "james mary robert patricia john jennifer michael linda david elizabeth william barbara richard susan joseph jessica thomas sarah charles karen "
    "daniel lisa matthew nancy anthony betty mark sandra donald margaret steven ashley paul emily andrew donna peter laura anna maria hans klaus "
    "jürgen wolfgang ursula sabine monika petra stefan andreas pierre jean marie michel isabelle nathalie françois luc josé juan carlos luis "
    "carmen pilar antonio manuel francisco ana lucía sofía martín".split()
)
COMMON = frozenset(
    "the of and to in is it for on with that as at by be this are from was not or an monday tuesday wednesday thursday friday saturday sunday january "
    "february march april may june july august september october november december street university license version public general der die das und "
    "ist le la les des est el los las del que".split()
)
SECRET_WORDS = ("token", "secret", "passw", "passwd", "pwd", "api", "key", "bearer", "credential", "auth", "private")
NUMBER_WORDS = ("ssn", "social", "phone", "tel", "mobile", "cell", "fax", "call", "passport", "account", "iban", "licen", "dob", "birth")
NAME_WORDS = ("mr", "mrs", "ms", "dr", "prof", "herr", "frau", "señor", "señora", "mme", "monsieur", "name", "named", "contact", "attn", "sincerely", "regards")
AGAINST_WORDS = ("page", "vol", "version", "isbn", "issn", "chapter", "section", "figure", "table", "commit", "sha", "md5", "checksum", "build", "item")
_WORD = re.compile(r"[^\W\d_]+")
_SHAPES = (re.compile(r"[0-9a-f]{32,}|[0-9A-F]{32,}"), re.compile(r"[0-9]{3}-[0-9]{2}-[0-9]{4}|\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}"))

LABELERS = ("form", "gazetteer", "context", "against", "mark", "mixture")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the four base kinds, in code points."""
    out = []
    end = 0
    if "@" in text:
        for m in _AT.finditer(text):
            s = m.start()
            while s > end and text[s - 1] in _LOCAL:
                s -= 1
            if s < m.start():
                out.append((s, m.end(), "email"))
                end = m.end()
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
                out.append((*m.span(), "ip"))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = m[0].replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    out.append((*m.span(), "card"))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum(c in "0123456789" for c in m[0]) <= 15:
                    out.append((*m.span(), "phone"))
    return sorted(out, key=lambda x: (x[0], ORDER[x[2]]))


def _near(text: str, start: int, end: int) -> tuple[list[str], str]:
    """The lower-case words just before a span, and the marks that touch it on the left."""
    left = text[max(0, start - 32) : start]
    return [w.lower() for w in _WORD.findall(left)][-3:], left.rstrip()[-2:]


def votes(text: str, start: int, end: int, kind: str) -> tuple[int, ...]:
    """One vote of each labeler: 1 for, -1 against, 0 none."""
    s = text[start:end]
    before, mark = _near(text, start, end)
    words = [w.lower() for w in _WORD.findall(s)]
    topic = {"secret": SECRET_WORDS, "number": NUMBER_WORDS, "name": NAME_WORDS}[kind]
    starts = (lambda w: w in topic) if kind == "name" else (lambda w: w.startswith(topic))
    if kind == "secret":
        body = s.rstrip("=")
        form = 1 if _SHAPES[0].fullmatch(body) or len(body) >= 24 and len(set(body)) >= 12 and any(c.isupper() for c in body) and any(c.islower() for c in body) else 0
        mixture = 1 if 0.15 <= sum(c in "0123456789" for c in s) / len(s) <= 0.9 else -1
        gazetteer = -1 if "/" in s and s.count("/") > 2 or any(w in COMMON for w in words if len(w) > 2) else 0
    elif kind == "number":
        form = 1 if _SHAPES[1].fullmatch(s) else 0
        digits = [c for c in s if c in "0123456789"]
        mixture = -1 if len(set(digits)) < 3 else 0
        gazetteer = -1 if re.fullmatch(r"(?:19|20)[0-9]{2}[-/.][01]?[0-9][-/.][0-3]?[0-9]|[0-3]?[0-9][-/.][0-3]?[0-9][-/.](?:19|20)[0-9]{2}", s) else 0
    else:
        form = 0
        gazetteer = 1 if words[0] in FIRST_NAMES else -1 if any(w in COMMON for w in words) else 0
        mixture = -1 if len(set(words)) < len(words) else 0
    context = 1 if any(starts(w) for w in before) else 0
    against = -1 if any(w in AGAINST_WORDS for w in before) else 0
    sign = 1 if kind != "name" and mark.strip('"').endswith(("=", ":")) or kind != "name" and mark[-1:] == '"' and mark[:1] in "=: " else 0
    return form, gazetteer, context, against, sign, mixture


def candidates(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str, int]]:
    """(start, end, kind, pattern): spans that at least one labeler votes for and that no base span touches."""
    found = []
    if _DIGIT.search(text):
        found += [(*m.span(), "secret") for m in _SECRET.finditer(text) if _DIGIT.search(m[0]) and re.search("[A-Za-z]", m[0])]
        found += [(*m.span(), "number") for m in _NUMBER.finditer(text)]
    found += [(*m.span(), "name") for m in _NAME.finditer(text)]
    out, taken, i = [], 0, 0
    for s, e, kind in sorted(found, key=lambda x: (x[0], -x[1])):
        while i < len(base) and base[i][1] <= s:
            i += 1
        if s < taken or any(b[0] < e and b[1] > s for b in base[max(0, i - 4) : i + 4]):
            continue
        v = votes(text, s, e, kind)
        if 1 in v:
            taken = e
            out.append((s, e, kind, sum((x + 1) * 3**k for k, x in enumerate(v))))
    return out


def unpack(pattern: np.ndarray) -> np.ndarray:
    return np.stack([pattern // 3**k % 3 - 1 for k in range(len(LABELERS))], -1)


def expectation_maximisation(vote: np.ndarray, count: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray, float]:
    """Dawid-Skene over vote patterns: posteriors of each, P(vote | class) as [labeler, class, vote], and the prior.

    Pseudo-counts lean each labeler towards being right, so that a corpus whose candidates all agree doesn't flip."""
    q = 1 / (1 + np.exp(-vote.sum(1).astype(float)))
    lean = np.array([[4.0, 4.0, 1.0], [1.0, 4.0, 4.0]])  # of the votes -1, 0, 1 in the classes 0, 1
    hot = vote[:, :, None] == np.array([-1, 0, 1])
    for _ in range(rounds):
        w = np.stack([(1 - q) * count, q * count])
        table = np.einsum("cp,plv->lcv", w, hot) + lean
        table /= table.sum(2, keepdims=True)
        prior = (w[1].sum() + 2) / (count.sum() + 4)
        log = np.einsum("plv,lcv->pc", hot, np.log(table)) + np.log([1 - prior, prior])
        q = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -30, 30)))
    return q, table, prior


def features(vote: np.ndarray, kind: np.ndarray) -> np.ndarray:
    one_hot = [vote == 1, vote == -1, kind[:, None] == np.arange(len(MORE)), (vote.sum(1) >= 2)[:, None], (vote.sum(1) <= 0)[:, None], np.ones((len(vote), 1))]
    return np.concatenate(one_hot, 1).astype(float)


class SpanClassifier:
    """Labeler reliabilities by EM and the logistic weights trained on its posteriors. patterns: (kind, pattern, count)."""

    def __init__(self, kind: np.ndarray, pattern: np.ndarray, count: np.ndarray):
        vote = unpack(pattern)
        q = np.zeros(len(kind))
        self.reliability, self.prior = {}, {}
        for k, name in enumerate(MORE):
            if (mine := kind == k).any():
                q[mine], self.reliability[name], self.prior[name] = expectation_maximisation(vote[mine], count[mine])
        x, weight = features(vote, kind), count / max(1, count.sum())
        self.weights = np.zeros(x.shape[1])
        for _ in range(30):  # Newton steps on the ridge-penalised likelihood
            p = 1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30)))
            slope = x.T @ (weight * (q - p)) - 1e-4 * self.weights
            curve = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-4 * np.eye(x.shape[1])
            self.weights += np.clip(np.linalg.solve(curve, slope), -4, 4)
        self._known: dict[tuple[str, int], bool] = {}

    def accepts(self, kind: str, pattern: int) -> bool:
        if (kind, pattern) not in self._known:
            x = features(unpack(np.array([pattern])), np.array([MORE.index(kind)]))
            self._known[kind, pattern] = bool((x @ self.weights)[0] >= 0)
        return self._known[kind, pattern]


FOUND = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base string, starts array<int>, ends array<int>, kinds array<int>, patterns array<int>"
_FOUND = pa.schema([(n, {"long": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}[t]) for n, t in (x.split() for x in FOUND.split(", "))])


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for text in b.column(1).fill_null("").to_pylist():
            base = base_spans(text)
            more = candidates(text, base)
            line = ",".join(f"{k}:{s}:{e}" for s, e, k in base)
            n = [sum(x[2] == k for x in base) for k in KINDS] if base else [0, 0, 0, 0]
            rows.append((*n, hashlib.sha256(line.encode()).hexdigest(), line, [x[0] for x in more], [x[1] for x in more], [MORE.index(x[2]) for x in more], [x[3] for x in more]))
        cols = zip(*rows, strict=True) if rows else [[]] * 10
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, _FOUND.types[1:], strict=True))], schema=_FOUND)


def train(patterns: DataFrame) -> SpanClassifier:
    """patterns: rows (kind, pattern) of all candidates; what reaches the driver is at most 3 * 3**6 counts."""
    rows = patterns.groupBy("kind", "pattern").agg(F.count(F.lit(1)).alias("n")).orderBy("kind", "pattern").collect()
    kind, pattern, n = (np.array([r[k] for r in rows], np.int64) for k in range(3))
    return SpanClassifier(kind, pattern, n.astype(float))


def _verdicts(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        clf = model.value
        for b in batches:
            lines = []
            for base, starts, ends, kinds, patterns in zip(*(b.column(k).to_pylist() for k in range(6, 11)), strict=True):
                if not starts:
                    lines.append(base)
                    continue
                spans = [(int(s), int(e), k) for k, s, e in (x.split(":") for x in base.split(",") if x)]
                spans += [(s, e, MORE[k]) for s, e, k, p in zip(starts, ends, kinds, patterns, strict=True) if clf.accepts(MORE[k], p)]
                lines.append(",".join(f"{k}:{s}:{e}" for s, e, k in sorted(spans, key=lambda x: (x[0], ORDER[x[2]]))))
            yield pa.RecordBatch.from_arrays([*b.columns[:6], pa.array(lines, pa.string())], names=[*_FOUND.names[:6], "spans"])

    return run


def find_personal_data(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans ("kind:start:end,...")."""
    spark = docs.sparkSession
    small_batches(spark)
    found = cut(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(_find, FOUND))
    each = found.select(F.explode(F.arrays_zip("kinds", "patterns")).alias("x")).select(F.col("x.kinds").alias("kind"), F.col("x.patterns").alias("pattern"))
    model = spark.sparkContext.broadcast(train(each))
    return found.mapInArrow(_verdicts(model), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redacted(text: str, clf: SpanClassifier) -> str:
    """The text with every span replaced by its kind in angle brackets; of overlapping spans the longest first one counts."""
    base = base_spans(text)
    spans = base + [(s, e, k) for s, e, k, p in candidates(text, base) if clf.accepts(k, p)]
    if not spans:
        return text
    out, at = [], 0
    for s, e, k in sorted(spans, key=lambda x: (x[0], -x[1])):
        if s >= at:
            out += [text[at:s], f"<{k.upper()}>"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with `text` redacted in every row; other columns and null texts stay as they are."""
    spark = docs.sparkSession
    small_batches(spark)

    def patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [(MORE.index(k), p) for t in b.column(0).fill_null("").to_pylist() for _, _, k, p in candidates(t, base_spans(t))]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in got], pa.int32()) for k in (0, 1)], ["kind", "pattern"])

    model = spark.sparkContext.broadcast(train(docs.select(text).mapInArrow(patterns, "kind int, pattern int")))
    where = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        clf = model.value
        for b in batches:
            texts = [t if t is None else redacted(t, clf) for t in b.column(where).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if k == where else c for k, c in enumerate(b.columns)], names=b.schema.names)

    return docs.mapInArrow(run, docs.schema)
