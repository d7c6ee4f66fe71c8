"""Hierarchical residual packing of token sequences.

Level 0: every task tokenises its documents, cuts what exceeds the capacity, and packs its own pieces best-fit
decreasing. Nearly full bins are final. Each underfull bin goes up the tree as one item of its fill; a level merges
the bins of neighbouring tasks, about GROUP of them a group, and packs them best-fit again, until one group has seen
all that is left or a level no longer saves any bin. Final and residual bins alike keep all their pieces.

No task holds more than its own pieces or about GROUP bins. Best fit keeps open bins in a table by free space, so a
piece costs one find-first-set over `capacity` bits.

Defined cases: a null text is empty; an empty text is one piece (its end mark alone); an empty table gives no rows;
repeated or null keys are documents of their own; other columns are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import chain, compress, count, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwright.llm._text import cut, gather, small_batches

CACHE = 1 << 19  # words; about 100 MB in a worker
GROUP = 1 << 15
SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, bin long, offset long, final boolean"
_TYPES = pa.schema([(n, {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}[t]) for n, t in (x.split() for x in SCHEMA.split(", "))])


#: The lower-case letters of the Latin blocks up to U+024F.
_LETTERS = "".join(c for c in map(chr, range(0x61, 0x250)) if c.isalpha() and c.lower() == c)
#: ASCII punctuation and symbols but the apostrophe, which begins tokens with letters.
_MARKS = "".join(c for c in map(chr, range(0x21, 0x7F)) if not c.isalnum() and c != "'")
_PLAIN = re.compile(f"([{_LETTERS}]+)([{re.escape(_MARKS)}]*)")


def _appended(buffer: np.ndarray, n: int, values: np.ndarray) -> np.ndarray:
    """buffer[:n] and the values behind them, in place if there is room, else in a buffer of twice the need."""
    if n + len(values) > len(buffer):
        buffer = np.concatenate([buffer[:n], np.zeros(n + 2 * len(values), buffer.dtype)])
    buffer[n : n + len(values)] = values
    return buffer


def folded(raw: bytes) -> bytes:
    """ASCII letters in lower case, as the tokenizer's own normaliser will make them; not where combining marks (U+0300 to
    U+036F) follow letters, because composition comes before lower case there."""
    return raw if b"\xcc" in raw or b"\xcd" in raw else raw.lower()


class WordEncoder:
    """Ids by the tokenizers library, as its encode(text, add_special_tokens=False) gives them.

    Words between ASCII white space never share a token in a tokenizer whose pre-tokenizer drops white space, so the ids of
    a word are kept and the library sees each new word once. Letter case, marks behind letters (tokens of their own), and
    words of lower-case Latin letters, which the normaliser leaves alone and which go to the library's model without an
    encoding around each, are short cuts of the same kind. The constructor asks the tokenizer which of these hold. Special
    tokens that a text spells out stand for themselves, as in the library: they part the text and have their own ids."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        self.special = {t.content: k for k, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.parting = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) or r"(?!)")
        probe = Tokenizer.from_file(path)
        pre = lambda x: [p for p, _ in probe.pre_tokenizer.pre_tokenize_str(x)] if probe.pre_tokenizer else [x]
        plain = not any(t.normalized or t.lstrip or t.rstrip or t.single_word for t in probe.get_added_tokens_decoder().values())
        self.by_word = plain and all(pre(f"ab{x}cd") == ["ab", "cd"] for x in " \t\n\r\x0b\x0c")
        upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
        self.fold = bool(probe.normalizer) and probe.normalizer.normalize_str(upper) == lower
        t = self.tokenizer
        t.encode_special_tokens = True  # words are without special tokens: a folded one isn't one
        self.bare, self.signs, self.ends = None, {}, False
        if t.normalizer and t.pre_tokenizer and t.normalizer.normalize_str(_LETTERS) == _LETTERS:
            self.signs = {ord(c): "".join(pre(c)) for c in _LETTERS}  # the model's signs for a letter's bytes
            if pre(_LETTERS) == [_LETTERS.translate(self.signs)] and [x.id for x in t.model.tokenize(pre(_LETTERS)[0])] == self._ids([_LETTERS])[0]:
                self.bare = t.model.tokenize
                marks = [*_MARKS, *(x + y for x in _MARKS for y in _MARKS), _MARKS]
                ab, *both = self._ids(["ab", *(f"ab{x}" for x in marks)])
                self.ends = all(x == ab + y for x, y in zip(both, self._ids(marks), strict=True)) and all(pre(f"ab{x}")[:1] == ["ab"] for x in marks)

        self.known: defaultdict[bytes, int] = defaultdict(count().__next__)  # a new word takes the next number
        for x in self.special:
            self.known[b" " + x.encode()]  # no word begins with a space
        self.flat, self.table = np.array(list(self.special.values()), np.uint32), np.arange(len(self.special) + 1)
        self.uses = np.zeros(len(self.special), np.int64)

    def _forget(self) -> None:
        """Leaves the special tokens and, of the words that were met more than once, the most frequent: half the cache at
        most. Their uses are halved, so that words of former texts give way."""
        n = len(self.special)
        often = n + np.flatnonzero(self.uses[n : len(self.known)] > 1)
        most = np.sort(often[np.argsort(-self.uses[often], kind="stable")[: CACHE // 2]])
        kept = np.concatenate([np.arange(n), most])
        stays = np.zeros(len(self.known), bool)
        stays[kept] = True
        words = list(compress(self.known, stays))
        self.known = defaultdict(count(len(words)).__next__, zip(words, range(len(words)), strict=True))
        self.flat, self.table = gather(self.flat, self.table, kept)
        self.uses = self.uses[kept] // 2

    def _words(self, text: str) -> list[bytes]:
        split = lambda x: (folded(x.encode()) if self.fold else x.encode()).split()
        out, at = [], 0
        for m in self.parting.finditer(text):
            out += [*split(text[at : m.start()]), b" " + m[0].encode()]
            at = m.end()
        return out + split(text[at:]) if at else split(text)

    def _whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Of a tokenizer whose words can't be told apart beforehand."""
        self.tokenizer.encode_special_tokens = False
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(ids), np.uint32), np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int64)

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if not self.by_word:
            return self._whole(texts)
        if len(self.known) > CACHE:
            self._forget()
        known, base = self.known, len(self.known)
        parts = [self._words(t) for t in texts]
        n = np.fromiter(map(len, parts), np.int64, len(parts))
        picks = np.fromiter(map(known.__getitem__, chain.from_iterable(parts)), np.int64, int(n.sum()))
        self._learn(base)
        self.uses = _appended(self.uses, base, np.zeros(len(known) - base, np.int64))
        np.add.at(self.uses, picks, 1)
        ids, off = gather(self.flat, self.table[: len(known) + 1], picks)
        return ids, off[np.concatenate([[0], np.cumsum(n)])]

    def _ids(self, words: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _learn(self, base: int) -> None:
        """The ids of the words that have been numbered from `base` on."""
        n = len(self.known) - base
        if not n:
            return
        names = b" ".join(islice(reversed(self.known), n)).decode().split(" ")[::-1]  # no word has a space, but special tokens, which aren't new
        ids: list[list[int]] = [[]] * n
        other, marked = [], []
        bare, signs, plain = self.bare, self.signs, _PLAIN.fullmatch
        for i, name in enumerate(names):
            m = plain(name) if bare else None
            if m is None or (m[2] and not self.ends):
                other.append(i)
                continue
            ids[i] = [t.id for t in bare(m[1] if name.isascii() else m[1].translate(signs))]
            if m[2]:
                marked.append((i, m[2]))
        for i, got in zip(other, self._ids([names[i] for i in other]) if other else (), strict=True):
            ids[i] = got
        marks = list({x for _, x in marked})
        of = dict(zip(marks, self._ids(marks) if marks else (), strict=True))
        for i, x in marked:
            ids[i] += of[x]
        size = np.fromiter(map(len, ids), np.int64, n)
        at = int(self.table[base])
        self.flat = _appended(self.flat, at, np.fromiter(chain.from_iterable(ids), np.uint32, int(size.sum())))
        self.table = _appended(self.table, base + 1, at + np.cumsum(size))


_loaded: dict[str, WordEncoder] = {}


def word_encoder(path: str) -> WordEncoder:
    if path not in _loaded:
        _loaded[path] = WordEncoder(path)
    return _loaded[path]


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: each item's bin and its offset there, and the bins' fills."""
    order = np.argsort(-sizes, kind="stable")
    bin_of, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]
    free_mask, fills = 0, []
    for i, size in zip(order.tolist(), sizes[order].tolist(), strict=True):
        fitting = free_mask >> size
        if fitting:
            free = size + ((fitting & -fitting).bit_length() - 1)
            b = open_at[free].pop()
            if not open_at[free]:
                free_mask ^= 1 << free
        else:
            b, free = len(fills), capacity
            fills.append(0)
        bin_of[i], offset[i] = b, fills[b]
        fills[b] += size
        free -= size
        if free:
            open_at[free].append(b)
            free_mask |= 1 << free
    return bin_of, offset, np.array(fills, np.int64)


def _pack_items(items: dict[str, np.ndarray], capacity: int, slack: int, base: int) -> pa.RecordBatch:
    """items: pieces with (bin, offset) of the level below; packs the bins and shifts the pieces along."""
    below, first, back = np.unique(items["bin"], return_index=True, return_inverse=True)
    fill = np.bincount(back, weights=items["length"], minlength=len(below)).astype(np.int64)
    bin_of, at, fills = best_fit(fill, capacity)
    items = items | {
        "bin": base + bin_of[back],
        "offset": items["offset"] + at[back],
        "final": (fills >= capacity - slack)[bin_of[back]],
    }
    return pa.RecordBatch.from_arrays([pa.array(items[n], t) for n, t in zip(_TYPES.names, _TYPES.types, strict=True)], schema=_TYPES)


def _merge(level: int, fan_in: int, capacity: int, slack: int) -> Callable[[pa.Table], pa.Table]:
    """Packs the bins of fan_in neighbouring tasks of the level below."""

    def merge(table: pa.Table) -> pa.Table:
        items = {n: table.column(n).to_numpy() for n in _TYPES.names if n != "doc_id"}
        number = (int(items["bin"][0]) & ((1 << 56) - 1)) >> 32
        base = (level << 56) + (number // fan_in << 32)
        out = _pack_items(items | {"doc_id": np.zeros(len(table), np.int64)}, capacity, slack, base)
        return pa.table([table.column("doc_id").combine_chunks(), *out.columns[1:]], schema=_TYPES)

    return merge


def cut_pieces(ids: np.ndarray, off: np.ndarray, end: int, capacity: int) -> Iterator[tuple[int, int, int, int, int]]:
    """(document, piece, start, length, crc32) of every piece; each document ends with the id `end`."""
    tail = np.array([end], "<u4").tobytes()
    raw = ids.astype("<u4").tobytes()
    for d, (s, e) in enumerate(zip(off[:-1].tolist(), off[1:].tolist(), strict=True)):
        body = raw[4 * s : 4 * e] + tail
        for k, at in enumerate(range(0, len(body), 4 * capacity)):
            part = body[at : at + 4 * capacity]
            yield d, k, at // 4, len(part) // 4, zlib.crc32(part)


def pack(
    docs: DataFrame, path: str, capacity: int = 4096, end: int = 1, slack: int | None = None, group: int = GROUP, key: str = "doc_id", text: str = "text",
    make_encoder: Callable = word_encoder,
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    small_batches(spark)
    slack = capacity // 256 if slack is None else slack

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from meshwright.llm.bpe import ranges

        encode, rows, keys, n = make_encoder(path), [], [], 0
        for b in batches:
            keys.append(b.column(0))
            for some in ranges(b.column(1).fill_null("").to_pylist(), 1 << 19):
                got = np.array(list(cut_pieces(*encode(some), end, capacity)), np.int64).reshape(-1, 5)
                got[:, 0] += n
                n += len(some)
                rows.append(got)
        if not rows:
            return
        doc, piece, start, length, crc = np.concatenate(rows).T
        ids = pa.chunked_array(keys).combine_chunks()
        items = {"piece": piece, "start": start, "length": length, "ids_crc32": crc, "bin": np.arange(len(doc)), "offset": np.zeros(len(doc), np.int64)}
        out = _pack_items(items | {"doc_id": np.zeros(len(doc), np.int64)}, capacity, slack, TaskContext.get().partitionId() << 32)
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(doc)), *out.columns[1:]], schema=_TYPES)

    level = cut(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(local, SCHEMA))
    done, rest, k = [level.where("final")], level.where("not final"), 0
    task = F.shiftright(F.col("bin").bitwiseAND((1 << 56) - 1), 32)
    bins, tasks = rest.agg(F.sum((F.col("offset") == 0).cast("int")), F.count_distinct(task)).first()
    while (bins or 0) > 1:
        k += 1
        fan_in = max(2, tasks * group // bins)
        level = cut(rest.groupBy(F.floor(task / fan_in).alias("g")).applyInArrow(_merge(k, fan_in, capacity, slack), SCHEMA))
        done.append(level.where("final"))
        rest = level.where("not final")
        before, after = bins, level.where("offset = 0").count()
        bins, tasks = rest.agg(F.sum((F.col("offset") == 0).cast("int")), F.count_distinct(task)).first()
        if tasks <= 1 or after == before:
            break
    done.append(rest)
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("bin").alias("sequence_id"), "offset")
