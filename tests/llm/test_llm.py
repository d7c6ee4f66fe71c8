"""Each operator against a brute-force version, and its defined cases on a small awkward table."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers as P
from pyspark.sql import functions as F

import corpus_pipeline
from meshwright.llm import bpe, exact_dedup, html_extraction, language_id, near_dedup, packing, perplexity, pii, sharding, suffix_dedup

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omikron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "s", "ed", "ing"]) for _ in range(n))


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows and columns of clashing names."""
    rng = random.Random(1)
    base = [prose(rng, rng.randint(5, 120)) for _ in range(60)]
    rows = [(i, t, rng.choice(["en", "de", None]), f"host{i % 3}.example.com", len(t)) for i, t in enumerate(base)]
    rows += [(100 + i, base[i], "en", "h", 1) for i in range(15)] + [(100, base[0], "en", "h", 1)]
    rows += [(200 + i, base[i] + " tail", "en", None, 1) for i in range(20)]
    rows += [(300, "", "en", "h", 0), (301, None, None, None, None), (None, base[1], "xx-YY", "h", 3), (302, "word " * 30000, "en", "h", 1), (303, "é" * 300, "fr", "h", 1)]
    rows += [(304, "mail bob@example.com or +49 123 456 7890, 10.0.0.1 " * 3, "en", "h", 1), (305, "\n\n \t", "en", "h", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    extra = {c: F.lit(7) for c in ("rid", "kept", "digest", "bucket", "label", "__rid", "raw", "size", "bin", "h")}
    return df.withColumns(extra).repartition(3).checkpoint() if spark.sparkContext.setCheckpointDir("/tmp/checkpoints") is None else df


def pairs(df):
    return [(r.doc_id, r.text or "") for r in df.collect()]


def test_every_operator_on_an_empty_table(spark, awkward):
    none = awkward.limit(0).checkpoint()
    assert sharding.shard_by_bytes(none).count() == 0 and exact_dedup.exact_dedup(none).count() == 0 and near_dedup.near_duplicates(none).count() == 0
    assert suffix_dedup.remove_repeats(none).count() == 0 and pii.find_personal_data(none).count() == 0 and perplexity.quality(none).count() == 0
    assert language_id.identify(none, declared=F.col("lang"), host=F.col("source")).count() == 0 and packing.pack(none, P.path("word_bpe_49k.json")).count() == 0
    assert bpe.bpe_round_trip(none, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0


def test_shards(awkward):
    got, rows = sharding.shard_by_bytes(awkward, 4).collect(), pairs(awkward)
    size = [len(t.encode()) + 1 for _, t in rows]
    assert sorted(r.size for r in got) == sorted(size)
    by = collections.defaultdict(list)
    for r in got:
        by[r.shard].append(r)
    for rs in by.values():
        assert sorted(r.slot for r in rs) == list(range(len(rs)))
    upto, shard, slots = 0, [], collections.Counter()
    for n in size:  # the middle of a row against the equal cuts, in the table's order
        k = min(3, (2 * upto + n) * 4 // (2 * sum(size)))
        upto += n
        shard.append((k, slots[k]))
        slots[k] += 1
    assert sorted((r.shard, r.slot, r.size) for r in got) == sorted((k, at, n) for (k, at), n in zip(shard, size, strict=True))
    assert collections.Counter(r.text_crc32 for r in got) == collections.Counter(zlib.crc32(t.encode()) for _, t in rows)


@pytest.mark.parametrize("digest_bytes", [16, 1])
@pytest.mark.parametrize("keep", ["max", "min"])
def test_exact_dedup(awkward, digest_bytes, keep):
    got = exact_dedup.exact_dedup(awkward, keep=keep, digest_bytes=digest_bytes, capacity=8).collect()
    groups = collections.defaultdict(list)
    for d, t in pairs(awkward):
        groups[hashlib.sha256(t.encode()).hexdigest()].append(d)
    assert len(got) == sum(map(len, groups.values()))
    kept = collections.Counter()
    for r in got:
        ids = [d for d in groups[r.text_sha256] if d is not None]
        assert r.group_size == len(groups[r.text_sha256]) and (r.keep_id == (max(ids) if keep == "max" else min(ids)) if ids else r.keep_id is None)
        kept[r.text_sha256] += r.kept
    assert set(kept.values()) == {1}


def near_classes(rows):
    """Sorted lists of the doc_ids that links of plain Jaccard 0.8 or more, and equal texts, join; by all pairs."""

    def shingles(t):
        w = t.split()
        return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])

    texts = sorted({t for _, t in rows})
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8:
                root[find(i)] = find(j)
    out = collections.defaultdict(list)
    for d, t in rows:
        out[find(texts.index(t))].append(d)
    return sorted((sorted(ids, key=lambda x: (x is None, x or 0)) for ids in out.values()), key=str)


def test_near_dedup(awkward):
    want = near_classes(pairs(awkward))
    got = collections.defaultdict(list)
    result = near_dedup.near_duplicates(awkward).collect()
    for r in result:
        got[r.class_id].append(r.doc_id)
    assert sorted((sorted(ids, key=lambda x: (x is None, x or 0)) for ids in got.values()), key=str) == want
    assert sum(r.kept for r in result) == len(want)


def test_near_copies_that_repeat_a_passage(spark):
    """Plain Jaccard 0.83, probability Jaccard about 0.5: neither banding nor the pair filter may go by weights alone."""
    rng = random.Random(11)
    rows, texts = [], []
    for k in range(30):
        w = ["".join(rng.choice("abcdefghij") for _ in range(7)) for _ in range(324)]
        texts.append((" ".join(w[:300]), " ".join(w[:276] + w[300:] + w[:100] * 64)))
        rows += [(2 * k, texts[-1][0]), (2 * k + 1, texts[-1][1])]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.class_id) for r in got} == {(d, d // 2 * 2) for d, _ in rows}
    batch = pa.RecordBatch.from_arrays([pa.array([0, 1]), pa.array(texts[0])], ["rid", "text"])
    (fine,) = near_dedup._fine(5, 2048)([batch])
    plain, repeated = (np.array(x, np.int64).view(np.uint64) for x in (fine.column("planes")[0].as_py(), fine.column("unit")[1].as_py()))
    differ = plain ^ repeated
    assert fine.column("unit")[0].as_py() is None and np.bitwise_count(differ[:32] | differ[32:]).sum() <= 2048 * 0.15 + 4.1 * (2048 * 0.85 * 0.15) ** 0.5


def test_prob_min_hash_estimates_probability_jaccard():
    rng = np.random.default_rng(0)
    h = rng.integers(1, 1 << 63, 300).astype(np.uint64)
    a, b = (h[:250], np.ones(250)), (h[50:], np.ones(250))
    row = np.concatenate([np.zeros(250, np.int64), np.ones(250, np.int64)])
    sig = near_dedup.prob_min_hash(row, np.concatenate([a[0], b[0]]), np.ones(500), 2, 4096)
    order = lambda x: (np.sort(x[0]), x[1])
    plain, prob = near_dedup.similarity(order(a), order(b))
    assert plain == pytest.approx(200 / 300) and prob == pytest.approx(plain) and (sig[0] == sig[1]).mean() == pytest.approx(plain, abs=0.04)


@pytest.mark.parametrize(("hot", "per"), [(1 << 14, 40_000), (2, 50)])
def test_suffix_dedup(spark, hot, per):
    rng = random.Random(3)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(400))
    rows = [(i, "".join(rng.choice("abcdefgh ") for _ in range(rng.randint(0, 300))) + passage[rng.randint(0, 100) : rng.randint(250, 400)] + "é" * rng.randint(0, 20)) for i in range(40)]
    rows += [(50, ""), (51, None), (52, "x" * 900), (53, "x" * 199), (54, "xy" * 600), (54, "xy" * 600), (None, passage)]
    seen = collections.Counter(b[i : i + 200] for b in ((t or "").encode() for _, t in rows) for i in range(len(b) - 199))
    want = []
    for d, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 199):
            if seen[b[i : i + 200]] > 1:
                gone[i : i + 200] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        want.append((d, len(b), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), hot=hot, per_bucket=per)
    assert collections.Counter(map(str, want)) == collections.Counter(str(tuple(r)) for r in got.drop("kept_text").collect())


def test_loser_tree_never_disagrees_with_sorting():
    rng = random.Random(0)
    for _ in range(300):
        runs = []
        for _ in range(rng.randint(1, 6)):
            s = sorted(bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(1, 6)))
            runs.append((s, [suffix_dedup.common_prefix(s[i - 1], s[i], 0) if i else 0 for i in range(len(s))]))
        merged = list(suffix_dedup.merge_runs(runs))
        out = [runs[r][0][i] for r, i, _ in merged]
        assert out == sorted(x for r in runs for x in r[0])
        assert [x[2] for x in merged][1:] == [suffix_dedup.common_prefix(a, b, 0) for a, b in zip(out, out[1:], strict=False)]


def test_bpe(awkward):
    import tiktoken

    enc = bpe.encoder(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    ref = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=enc.ranks.rank, special_tokens={})
    rng = random.Random(2)
    texts = ["", "a" * 3000, "aba" * 200 + "ab" * 300, "".join(rng.choice("abAB the  \n\t é漢😀1²") for _ in range(3000)), "x" * 257]
    ids, off = enc(texts)
    assert [ids[s:e].tolist() for s, e in zip(off[:-1], off[1:], strict=True)] == [ref.encode_ordinary(t) for t in texts]
    got = collections.Counter((r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.bpe_round_trip(awkward, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect())
    sha = lambda b: hashlib.sha256(b).hexdigest()
    assert got == collections.Counter((len(i), sha(" ".join(map(str, i)).encode()), sha(t.encode())) for _, t in pairs(awkward) for i in [ref.encode_ordinary(t)])
    coded = bpe.bpe_encode(awkward, P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    assert collections.Counter(r.text for r in bpe.bpe_decode(coded, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()) == collections.Counter(t for _, t in pairs(awkward))


def test_packing(awkward):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    want = collections.Counter()
    for d, x in pairs(awkward):
        ids = [*t.encode(x, add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), 256)):
            want[d, k, at, len(ids[at : at + 256]), zlib.crc32(np.array(ids[at : at + 256], "<u4").tobytes())] += 1
    got = packing.pack(awkward, P.path("word_bpe_49k.json"), capacity=256, group=8).collect()
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    by = collections.defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for bin_ in by.values():
        at = 0
        for o, n in sorted(bin_):
            assert o == at
            at += n
        assert at <= 256
    assert len(by) <= 1.05 * -(-sum(r.length for r in got) // 256) + 2
    rng = random.Random(0)
    w = packing.WordEncoder(P.path("word_bpe_49k.json"))
    assert w(["hello <|endoftext|> world"])[0].tolist() == [3306, 49407, 1002]
    for _ in range(2000):
        x = "".join(rng.choice(["<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>"]) if rng.random() < 0.02 else rng.choice(" \t\n\r\x0b\x0c\x1c\x85\xa0　́İΣσaAbJé1²漢's-.,\u030c<|endoftext|>") for _ in range(rng.randint(0, 30)))
        assert w([x])[0].tolist() == t.encode(x, add_special_tokens=False).ids


def test_word_encoder_with_many_texts_and_a_full_cache(monkeypatch):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    w = packing.WordEncoder(P.path("word_bpe_49k.json"))
    assert w.bare is not None
    monkeypatch.setattr(packing, "CACHE", 300)  # forgets between the calls
    rng = random.Random(1)
    letters = packing._LETTERS + "abcdefghijklmnopqrstuvwxyz" * 8
    for _ in range(40):
        texts = ["".join(rng.choice(letters if rng.random() < 0.8 else " .,'ÀŒ1\u0301\n|ª") for _ in range(rng.randint(0, 60))) for _ in range(50)]
        ids, off = w(texts)
        assert [ids[a:b].tolist() for a, b in zip(off[:-1], off[1:], strict=True)] == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_new_words_of_letters_and_marks_are_encoded_without_an_encoding_each():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    w = packing.WordEncoder(P.path("word_bpe_49k.json"))
    encoded, ids_of = [], w._ids
    w._ids = lambda *a: encoded.extend(a[-1]) or ids_of(*a)
    text = "Thereaes euxan$$$ ciónes$$$ asgañ, ñóue, es,mssa it's kg2 oneau"
    assert w([text])[0].tolist() == t.encode(text, add_special_tokens=False).ids
    assert sorted(encoded) == ["$$$", ",", "es,mssa", "it's", "kg2"]
    flat, table, uses = w.flat, w.table, w.uses
    w([text])
    assert w.flat is flat and w.table is table and w.uses is uses  # nothing new: no copy of what is known
    rng = random.Random(2)
    signs = "".join(map(chr, range(0x20, 0x7F))) + "éßñ×÷\u0301\u0338Σ漢²" + "'.,abcst" * 4
    for _ in range(60):
        texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 80))) for _ in range(50)]
        ids, off = w(texts)
        assert [ids[a:b].tolist() for a, b in zip(off[:-1], off[1:], strict=True)] == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_personal_data(awkward):
    def brute(t):
        out = [(m.start(), m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
        out += [(m.start(), m.end(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
        out += [(m.start(), m.end(), "card") for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 12 <= len(re.sub("[ -]", "", m[0])) <= 19 and pii.luhn(re.sub("[ -]", "", m[0]))]
        out += [(m.start(), m.end(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
        return sorted(out, key=lambda x: (x[0], pii.ORDER[x[2]]))

    rng = random.Random(0)
    bits = ["", "a", "b@c.d", "1.2.3.4", "+49 123 456 789", "4539 1488 0343 6467", "@", "..", "1", "-", " ", "%", "256.1.1.1", "x@y", "é", "0001.2.3.4.5"]
    for _ in range(2000):
        t = "".join(rng.choice(bits) for _ in range(12))
        assert pii.base_spans(t) == brute(t)
    assert pii.base_spans("1" * 50000) == [] and len(pii.base_spans("a" * 50000 + "@b.c")) == 1
    got = {r.doc_id: r for r in pii.find_personal_data(awkward).collect()}
    assert (got[304].n_email, got[304].n_ip, got[304].n_phone) == (3, 3, 3) and got[301].spans == ""
    assert got[304].base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, e, k in brute("mail bob@example.com or +49 123 456 7890, 10.0.0.1 " * 3)).encode()).hexdigest()
    clean = {r.doc_id: r.text for r in pii.redact(awkward).collect()}
    assert "<EMAIL>" in clean[304] and "bob@" not in clean[304] and clean[301] is None


def test_secrets_pass_and_plain_names_do_not():
    vote = np.array([[1, 0, 1, 0, 1, 1], [0, 0, 0, -1, 1, -1]])
    clf = pii.SpanClassifier(np.array([0, 0]), sum((vote[:, k] + 1) * 3**k for k in range(6)), np.array([50.0, 50.0]))
    codes = [int(sum((v + 1) * 3**k for k, v in enumerate(x))) for x in vote]
    assert clf.accepts("secret", codes[0]) and not clf.accepts("secret", codes[1])


def test_quality(awkward):
    got = collections.Counter((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.base_failed) for r in perplexity.quality(awkward, few=5).collect())
    want = collections.Counter()
    for _, t in pairs(awkward):
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        seen, lines, dup = collections.defaultdict(list), set(), 0
        for i in range(len(w) - 7):
            seen[tuple(w[i : i + 8])].append(i)
        rep = len({k for v in seen.values() if len(v) > 1 for i in v for k in range(i, i + 8)})
        for line in t.split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                dup += line in lines
                lines.add(line)
        want[len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(w) < 20 or 100 * rep > 30 * len(w)] += 1
    assert got == want


def brute_kneser_ney(text, lang_order=5):
    """p of every gram of the highest order, by dictionaries: modified Kneser-Ney, interpolated, over bytes."""
    raw = text.encode()
    orders = {5: collections.Counter(raw[i : i + 5] for i in range(len(raw) - 4))}
    for k in (4, 3, 2, 1):
        orders[k] = collections.Counter(g[1:] for g in orders[k + 1])
    lower = None
    for k in range(1, 6):
        n = collections.Counter(orders[k].values())
        y = n[1] / max(n[1] + 2 * n[2], 1)
        d = [0.0] + [max(0.0, min(i - 0.05, i - (i + 1) * y * n[i + 1] / max(n[i], 1))) for i in (1, 2, 3)]
        total, freed = collections.Counter(), collections.Counter()
        for g, c in orders[k].items():
            total[g[:-1]] += c
            freed[g[:-1]] += d[min(c, 3)]
        below = lower
        lower = {g: (c - d[min(c, 3)] + freed[g[:-1]] * (below[g[1:]] if below else 1 / 256)) / total[g[:-1]] for g, c in orders[k].items()}
    return lower


def test_kneser_ney_against_dictionaries(spark):
    rng = random.Random(9)
    text = prose(rng, 400)
    got = perplexity.kneser_ney(perplexity.count_top(spark.createDataFrame([("en", text)], "lang string, text string"), "lang", "text")).collect()
    want = brute_kneser_ney(text)
    assert len(got) == len(want) > 500
    for r in got:
        assert r.p == pytest.approx(want[r.gram.to_bytes(5)], rel=1e-9)
    by = collections.defaultdict(float)  # a context's probabilities, and the mass of what never followed it
    for r in got:
        by[r.gram >> 8] += r.p
    assert all(0 < v <= 1 + 1e-9 for v in by.values())


def test_a_model_in_parts_scores_alike(awkward):
    whole = {(r.doc_id, r.n_words, r.word_chars): r for r in perplexity.quality(awkward, few=5).collect()}
    parts = perplexity.quality(awkward, few=5, limit=300).collect()
    assert len(parts) == awkward.count()
    for r in parts:
        w = whole[r.doc_id, r.n_words, r.word_chars]
        assert r.kept == w.kept and (r.entropy is None) == (w.entropy is None) and (r.entropy or 0) == pytest.approx(w.entropy or 0, abs=1e-9)


def test_quality_rejects_what_no_other_text_supports(spark):
    """A document is scored without itself, and a few odd ones among many alike fall out of the band."""
    rng = random.Random(7)
    rows = [(i, prose(rng, 100), "en") for i in range(300)]
    odd = [(1000 + i, " ".join("".join(rng.choice("bcdfghjklmnpqrstvwxz0123456789") for _ in range(6)) for _ in range(100)), "en") for i in range(3)]
    got = {r.doc_id: r for r in perplexity.quality(spark.createDataFrame(rows + odd, "doc_id long, text string, lang string")).collect()}
    assert not any(got[d].kept for d, _, _ in odd) and sum(got[d].kept for d, _, _ in rows) >= 295
    assert min(got[d].entropy for d, _, _ in odd) > 4.5  # 30 letters and a space: they'd have under 1 bit with their own counts


def test_language(spark, awkward):
    rng = random.Random(5)
    langs = {"en": "the and with that from have".split(), "de": "und der nicht schon auch ein".split(), "fr": "les des une avec dans pour".split()}
    rows = [(i, " ".join(rng.choice(langs[x]) for _ in range(30)), x, f"{x}.example.{x}") for i in range(240) for x in [rng.choice(sorted(langs))]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    model = language_id.train(df.where("doc_id % 2 = 0").select(F.col("lang").alias("tag"), "text"))
    got = {r.doc_id: r for r in language_id.identify(df, model=model, host=F.col("source")).collect()}
    assert all(got[i].lang == x and got[i].kept for i, _, x, _ in rows)
    odd = {r.doc_id: r for r in language_id.identify(awkward, declared=F.col("lang"), host=F.col("source")).collect()}
    assert len(odd) >= 90 and odd[301].lang == "und" and not odd[300].kept and odd[5].kept


def test_rare_languages_are_learned(spark):
    """No language reaches 20 declared rows; and more languages than one model holds give the same result."""
    rng = random.Random(6)
    langs = {"en": "the and with that from have", "de": "und der nicht schon auch ein", "fr": "les des une avec dans pour", "fi": "ja ei joka kanssa mutta niin"}
    rows = [(i, " ".join(rng.choice(langs[x].split()) for _ in range(40)), x) for i in range(40) for x in [sorted(langs)[i % 4 if i < 36 else 0]]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    one = {r.doc_id: r for r in language_id.identify(df, declared=F.col("lang")).collect()}
    assert all(one[i].lang == x and one[i].kept for i, _, x in rows)
    parts = language_id.train(df.select(F.col("lang").alias("tag"), "text"), max_langs=1)
    many = {r.doc_id: r for r in language_id.identify(df, declared=F.col("lang"), model=parts).collect()}
    assert len(parts) == 4 and all((many[i].lang, many[i].kept) == (one[i].lang, one[i].kept) and abs(many[i].confidence - one[i].confidence) < 1e-6 for i in one)


def test_html():
    page = "<html><head><title>t</title></head><body><nav><a href=/>home</a></nav><div class='ad'>buy</div><article><h1>Head &amp; more</h1><p>One  two<br>three<p>Four</p></article><div id=comments>me</div><script>var t='</p>'</script><footer>f</footer></body>"
    assert html_extraction.extract(page) == "Head & more\nOne two three\nFour"
    for x, want in (("", ""), (None, ""), ("plain  text", "plain text"), ("<p>a", "a"), ("<script>x", ""), ("<!-- x", "")):
        assert html_extraction.extract(x) == want
    body = "<body><div>" + "<p>long text of the main part, again and again.</p>" * 5 + "</div><ul>" + "<li><a href=x>link</a></li>" * 9 + "</ul></body>"
    assert html_extraction.extract(body).count("main part") == 5 and "link" not in html_extraction.extract(body)
    html_extraction.extract("<div>" * 50000 + "<a '" * 1000)


def test_html_of_any_depth_and_elements_that_close_themselves():
    deep = "<body>" + "<div>" * 600 + "<nav>menu links</nav><p>real text</p>" + "</div>" * 600
    assert html_extraction.extract(deep) == "real text"
    assert html_extraction.extract("<p>before <svg width=1 /> after</p><p>more <svg><path/></svg>text</p>") == "before after\nmore text"
    html_extraction.extract("<p><table>" + "<span>" * 30000 + "<div>" * 30000 + "</b>" * 30000)


def test_density_chooses_without_an_article_element():
    para = "<p>" + "A sentence of the story that goes on for quite a while, with <a href=x>one link</a> in it. " * 4 + "</p>"
    junk = "<div>" + "<a href=x>somewhere else</a> " * 30 + "</div>"
    for tag in ("article", "main", "div", "section"):
        got = html_extraction.extract(f"<body>{junk}<{tag}><h2>Head</h2>{para * 5}</{tag}>{junk}</body>")
        assert got.startswith("Head\nA sentence") and got.count("\n") == 5 and "somewhere" not in got


def test_pages_with_nulls_repeats_and_clashing_names(spark):
    rows = [(1, "u", "<p>a  b</p>"), (1, "u", "<p>a  b</p>"), (None, None, None), (2, "u", ""), (3, "", "x" * 300_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"text": F.lit(1), "n_chars": F.lit(2), "__rid": F.lit(3)})
    got = collections.Counter((r.page_id, r.url, r.text, r.n_chars) for r in html_extraction.extract_pages(df).collect())
    assert got == {(1, "u", "a b", 3): 2, (None, None, "", 0): 1, (2, "u", "", 0): 1, (3, "", "x" * 300_000, 300_000): 1}
    assert html_extraction.extract_pages(df.limit(0)).count() == 0


def test_pipeline(spark, awkward, tmp_path):
    """Every stage against brute force on its own input, then the whole against the stages; nulls, repeats, clashing names, no rows."""
    from tokenizers import Tokenizer

    awkward.write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    none = docs.limit(0).checkpoint()
    steps = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, none, str(tmp_path)).count() == 0, name
        out = stage(spark, docs, str(tmp_path)).checkpoint()
        assert out.columns == awkward.columns, name
        steps.append((pairs(docs), pairs(out)))
        extra = [c for c in awkward.columns if c not in ("doc_id", "text", "lang", "source", "n_chars")]
        assert out.select(extra).distinct().count() == 1 and set(out.select(extra).first()) == {7}, name
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
    (raw, told), (_, single), (_, apart), (_, clean) = steps
    assert not collections.Counter(told) - collections.Counter(raw) and not {300, 301, 305} & {d for d, _ in told}
    assert {d for d, t in raw if d is not None and d < 200} <= {d for d, _ in told}  # clean documents stay
    best = {}
    for d, t in told:
        best[t] = max(best.get(t, -1), -1 if d is None else d)
    assert sorted(single) == sorted((d, t) for t, d in best.items())
    classes = near_classes(single)
    assert len(apart) == len(classes) and all(sum(d in c for d, _ in apart) == 1 for c in classes) and set(apart) <= set(single)
    before = dict(apart)
    assert sorted(d for d, _ in clean) == sorted(before) and not any(pii.base_spans(t) for _, t in clean)
    assert all(t == before[d] for d, t in clean if d != 304)
    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    packed = corpus_pipeline.run(spark, str(tmp_path)).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {r.doc_id: r.n for r in packed} == {d: len(t.encode(x, add_special_tokens=False).ids) + 1 for d, x in clean}
    none.write.parquet(f"{tmp_path}/empty/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").count() == 0


def test_a_hot_host_and_language_are_dealt_over_tasks_alike(spark, monkeypatch):
    rng = random.Random(8)
    langs = {"en": "the and with that from have", "de": "und der nicht schon auch ein", "fr": "les des une avec dans pour"}
    rows = [(i, " ".join(rng.choice(langs[x].split()) for _ in range(12)), x if i % 5 else None, f"{x}.org" if i % 3 else None) for i in range(120) for x in [rng.choice(sorted(langs))]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = []
    for hot in (200, 0.5, 3):  # all, none and some of the keys are hot
        monkeypatch.setattr(language_id, "HOT", hot)
        got.append(sorted((r.doc_id, r.lang, r.kept, round(r.confidence, 9)) for r in language_id.identify(df, declared=F.col("lang"), host=F.col("source")).collect()))
    assert got[0] == got[1] == got[2] and len(got[0]) == 120
