"""Periodic runs, phrases and repeated passages against plain versions, on hard small inputs."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from rowloom.llm import blocks, phrases, queries, repeats, runs
from rowloom.llm.text import SpanHasher
from rowloom.llm.words import sliding_argmin, sliding_min

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_runs(words):
    found = {}
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q):
                found.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted((s, n, q) for (s, n), q in found.items())


def strings(seed):
    """Random words of small alphabets with periods of many lengths written in, some broken, some nested."""
    rng = random.Random(seed)
    for size in (1, 2, 2, 3, 50):
        words = [b"%d" % rng.randrange(size) for _ in range(rng.randrange(1, 400))]
        for _ in range(rng.randrange(4)):
            a, p = rng.randrange(len(words)), rng.choice([1, 2, 3, 7, 8, 9, 15, 16, 17, 31, 32, 33, 40])
            end = min(len(words), a + p * rng.randrange(3, 7) + rng.randrange(p))
            for i in range(a + p, end):
                words[i] = words[i - p]
        yield words


@pytest.mark.parametrize("seed", range(40))
def test_runs_are_those_of_all_periods(seed):
    texts = list(strings(seed))
    assert runs.find_runs(texts) == [plain_runs(t) for t in texts]


def test_runs_of_edge_texts():
    texts = [[], [b"a"], [b"a"] * 5, [b"a"] * 6, [b"a", b"b"] * 4, [b"a"] * 3, [b"a"] * 3]
    assert runs.find_runs(texts) == [[], [], [], [(0, 6, 1)], [(0, 8, 2)], [], []]
    long = [b"%d" % i for i in range(5000)] * 4
    assert runs.find_runs([long, [b"x"]]) == [[(0, 20000, 5000)], []]
    assert runs.find_runs([]) == []


def test_sliding_minima():
    values = np.random.default_rng(1).integers(0, 5, 200).astype(np.uint64)
    for width in (1, 2, 3, 9, 11, 200):
        parts = [values[i : i + width] for i in range(201 - width)]
        assert sliding_min(values, width).tolist() == [p.min() for p in parts]
        assert sliding_argmin(values, width).tolist() == [i + int(p.argmin()) for i, p in enumerate(parts)]


def plain_op11(doc_id, text):
    words = WORD.findall(text or "")
    n = len(words)
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = plain_runs(words)
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    gone = {i for s, m, q in found for i in range(s + q, s + m)}
    lines = "".join(f"{s},{m},{q}\n" for s, m, q in found)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
            hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def tenth(start, count):
    """Ids whose texts get a period."""
    return [i for i in range(start, start + 40 * count) if zlib.crc32(str(i).encode()) % 10 == 0][:count]


def test_runs_query(spark, tmp_path):
    rng = random.Random(3)
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 300))) for _ in range(60)]
    rows = [*zip(tenth(100, 30), texts), *((i, t) for i, t in enumerate(texts[30:])), (-5, None), (-6, ""), (None, "a b c d"),
            (None, "x " * 20), (-7, "é é \tz\x0b" * 9), (-7, "é é \tz\x0b" * 9), (-8, "q r " * 1500), (tenth(9000, 1)[0], "")]
    docs = spark.createDataFrame([(*r, "n", 1) for r in rows], "doc_id long, text string, words string, g int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    columns = "doc_id n_runs start length period exponent_milli runs_sha256 collapsed_sha256".split()
    got = [tuple(r) for r in queries.op11_runs(spark, str(tmp_path)).select(*columns).collect()]
    assert sorted(map(repr, got)) == sorted(repr(plain_op11(*r)) for r in rows)
    assert queries.runs.periodic_runs(docs.limit(0)).count() == 0


# --- phrases -----------------------------------------------------------------------------


def plain_phrases(rows, least=30, top=2000):
    counts, totals = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for n in range(1, 5):
                for i in range(len(words) - n + 1):
                    counts[lang][tuple(words[i : i + n])] += 1
    out = []
    for lang, f in counts.items():
        chosen = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in chosen.items():
            around = [b for q, b in chosen.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
            if any(100 * b >= 80 * a for b in around):
                continue
            score, _, left, right = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, p, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, totals[lang], -score))
    return out


def some_phrases():
    rng = random.Random(5)
    words = "a b c d e. f g; h é ü\x0bx A,".split(" ")
    for i in range(150):
        text = " ".join(rng.choice(words) for _ in range(rng.randrange(80)))
        yield rng.choice(["en", "de", None, "und"]), text + (" red hot chili" if i % 3 else "\tRed  HOT")
    yield from [(None, None), ("en", ""), ("fr", "one two"), ("en", "la " * 3000), ("en", " \n.."), ("", "red hot " * 40)]


@pytest.mark.parametrize("top", [3, 2000])
def test_phrases(spark, top):
    rows = list(some_phrases())
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "lang string, text string, phrase string, f int")
    found = phrases.collocations(phrases.phrase_counts(docs.repartition(5)), top)
    got = [tuple(r) for r in found.select("group", "rank", "phrase", "a", "l", "r", "n", "score").collect()]
    assert sorted(got) == sorted(plain_phrases(rows, top=top)) and len(got) >= 8
    assert phrases.collocations(phrases.phrase_counts(docs.limit(0))).count() == 0


def test_phrases_of_one_fingerprint_keep_their_counts(spark, monkeypatch):
    """With fingerprints of a few bits nearly all collide."""
    call = SpanHasher.__call__
    monkeypatch.setattr(SpanHasher, "__call__", lambda self, *args: call(self, *args) % np.uint64(7))
    rows = list(some_phrases())[:60]
    numbers, ids, ends, tags = phrases_block(rows)
    names = list(dict.fromkeys(tags))
    of = np.array([names.index(t) for t in tags], np.int32)
    block = blocks.Block(pa.array(list(numbers), pa.binary()), np.array(ids, np.int32), np.array(ends), names, of)
    got = {n: {} for n in (1, 2, 3)}
    for n in (2, 3, 4):
        asked = phrases.Grams(block, {i: got[i] for i in range(1, n - 1)}, 1, n)
        for bucket, blob in asked.ask(n):
            got[n - 1][bucket] = phrases._answers(1)([blob])[0]
    grams = phrases.Grams(block, got, 1, 4)
    for n in (2, 3, 4):
        names = {}
        for starts, counts in grams.counted(n, got[n - 1]):
            for batch in grams.rows(starts, n, counts):
                for r in batch.to_pylist():
                    key = r["group"], r["phrase"]
                    names[key] = names.get(key, 0) + r["f"]
        plain = Counter()
        for start, end, tag in zip([0, *ends], ends, tags):
            for i in range(start, end - n + 1):
                plain[tag, b" ".join(block.words[x] for x in ids[i : i + n]).decode()] += 1
        assert names == plain


def phrases_block(rows):
    numbers, ids, ends, tags = blocks.Numbers(), [], [], []
    for lang, text in rows:
        for words in phrases.pieces((text or "").encode()):
            ids += [numbers[w] for w in words]
            ends.append(len(ids))
            tags.append(lang or "und")
    return numbers, ids, ends, tags


def test_score_passes_64_bits(spark):
    big = 10**17
    counts = spark.createDataFrame([("x", 1, "a", big), ("x", 1, "b", big + 7), ("x", 2, "a b", big - 1)],
                                   "group string, n int, phrase string, f long")
    row = phrases.collocations(counts).first()
    assert (row["score"], row["n"]) == (2_000_000 * (big - 1) // (2 * big + 7), 2 * big + 7)


# --- repeats -----------------------------------------------------------------------------


def plain_repeats(rows, n=13):
    first = {}
    texts = [(k, WORD.findall(t or "")) for k, t in rows]
    for k, words in texts:
        for i in range(len(words) - n + 1 if k is not None else 0):
            w = tuple(words[i : i + n])
            first[w] = min(first.get(w, k), k)
    out = []
    for k, words in texts:
        gone = set()
        for i in range(len(words) - n + 1 if k is not None else 0):
            if first[tuple(words[i : i + n])] < k:
                gone |= set(range(i, i + n))
        out.append((k, len(words), len(gone), " ".join(w for i, w in enumerate(words) if i not in gone)))
    return out


def passages(seed):
    rng = random.Random(seed)
    pool = [[f"w{rng.randrange(300)}" for _ in range(rng.randrange(5, 60))] for _ in range(12)]
    for k in range(60):
        words = [f"w{rng.randrange(300)}" for _ in range(rng.randrange(0, 80))]
        for _ in range(rng.randrange(5)):
            part = rng.choice(pool)
            low = rng.randrange(len(part))
            at = rng.randrange(len(words) + 1)
            words[at:at] = part[low : low + rng.randrange(10, 40)]
        yield k * 3 % 61 - 5, " ".join(words)
    yield from [(900, "la " * 500), (901, "la " * 40), (902, "x y " * 200), (903, "y x " * 20), (904, None), (905, ""), (906, "a b")]
    yield from [(None, "la " * 30), (None, "z " * 30), (907, "z " * 30), (907, "la " * 30), (908, "m " * 13), (908, "m " * 13)]
    yield from [(910, "é\x1f" + " é " * 14), (911, " é " * 15)]


@pytest.mark.parametrize(("seed", "size"), [(1, 1 << 23), (2, 3000), (3, 300), (4, 1)])
def test_repeats(spark, monkeypatch, seed, size):
    monkeypatch.setattr(blocks, "BLOCK_BYTES", size)
    rows = list(passages(seed))
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id int, text string, kept string").repartition(3)
    got = [(r["key"], r["n_words"], r["n_removed"], r["kept"], r["spans"]) for r in repeats.without_repeats(docs).collect()]
    assert sorted(map(repr, (g[:4] for g in got))) == sorted(map(repr, plain_repeats(rows)))
    assert all(sum(s["length"] for s in g[4]) == g[2] for g in got)
    if size == 300:
        assert repeats.without_repeats(docs.limit(0)).count() == 0


@pytest.mark.parametrize("bits", [1, 3])
def test_factors_do_not_trust_hashes(monkeypatch, bits):
    call = SpanHasher.__call__
    monkeypatch.setattr(SpanHasher, "__call__", lambda self, *args: call(self, *args) % np.uint64(bits))
    rng = np.random.default_rng(2)
    counts = rng.integers(1, 12, 120)
    documents = rng.integers(0, 30, 120)
    ids = rng.integers(0, 2, int((counts + 3).sum())).astype(np.int32)
    got = repeats.factor(ids, documents, counts, 4)
    ends = np.cumsum(counts + 3)
    windows = [[tuple(ids[e - n - 3 + i : e - n + 1 + i].tolist()) for i in range(n)] for e, n in zip(ends, counts)]
    first = {}
    for d, ws in zip(documents, windows):
        for w in ws:
            first[w] = min(first.get(w, d), d)
    assert got.tolist() == [sum(1 << i for i, w in enumerate(ws) if first[w] < d) for d, ws in zip(documents, windows)]
