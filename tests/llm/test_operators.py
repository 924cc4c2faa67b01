"""Every operator against a plain version of itself, with nulls, empty texts, repeated rows and empty tables."""

import base64
import hashlib
import os
import zlib
from collections import defaultdict

import numpy as np
import pytest

from rowloom.llm import chat, decontaminate, langid, minhash, mixing, quality, simhash, urls, warc
from rowloom.llm.components import components, written
from rowloom.llm.text import id_bucket
from rowloom.plans.queries import table

DATA = "/root/testdata/sf0.001"
WORDS = [f"w{i}x{i * 7 % 13}" for i in range(400)]


def text_of(seed, n=120):
    return " ".join(np.random.default_rng(seed).choice(WORDS, n))


EDGE = [(1, text_of(1)), (2, text_of(1)), (3, text_of(1).replace(WORDS[3], "changed", 1)), (4, None), (5, ""), (6, " \n"),
        (7, "one"), (7, "one"), (None, text_of(1)), (9, text_of(9, 20000)), (10, "Ä ö 日本"), (11, text_of(1).upper())]


@pytest.fixture(scope="module")
def edge(spark):
    rows = [(k, t, "x", "s") for k, t in EDGE]
    return spark.createDataFrame(rows, "doc_id long, text string, score string, fp string")


# --- 1 -----------------------------------------------------------------------------------

TURNS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "a \\ b</s>"), (2, 0, "user", "hi"), (2, 1, "assistant", "other"),
    (3, 0, "user", "hi"), (4, 0, "user", "hi"), (4, 1, "assistant", "a \\ b</s>"), (4, 2, None, None), (5, 0, "x<|y", "[INST]"),
    (None, 0, "user", "hi"), (6, None, "assistant", "first"), (6, 0, "assistant", "z"), (6, 0, "assistant", "z"), (7, 0, "assistant", ""),
]


@pytest.mark.parametrize("vocabulary", [False, True])
def test_conversations(spark, vocabulary):
    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json") if vocabulary else None
    turns = spark.createDataFrame([(*t, 1) for t in TURNS], "conv_id long, turn long, role string, text string, node int")
    forest = chat.format_conversations(turns, path)
    got = {r["conv"]: r for r in chat.digests(forest, path).collect()}
    convs = defaultdict(list)
    for c, t, role, text in TURNS:
        convs[c].append((-1 if t is None else t, role or "", text or ""))
    assert set(got) == set(convs)
    for c, rows in convs.items():
        rows.sort()
        loss = "".join(x for _, r, x in rows if r == "assistant")
        assert got[c]["n_turns"] == len(rows)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in rows).encode()).hexdigest()
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    nodes = {r["node"]: r for r in forest.nodes.collect()}
    prefixes = {tuple((r, x) for _, r, x in rows[: i + 1]) for rows in convs.values() for i in range(len(rows))}
    assert len(nodes) == len(prefixes)  # shared turns once
    ranks = defaultdict(list)
    for s in forest.steps.collect():
        ranks[s["rank"]].append((s["depth"], nodes[s["node"]]))
    for steps in ranks.values():
        before, position = set(), 0
        for _, node in sorted(steps, key=lambda s: s[0]):
            assert node["position"] == position
            assert {i for s in node["attends"] for i in range(s["start"], s["end"])} == before
            before |= set(range(node["start"], node["start"] + node["n"]))
            position += node["n"]
    order = sorted(nodes.values(), key=lambda r: r["start"])
    assert [r["start"] for r in order] == np.cumsum([0, *(r["n"] for r in order)])[:-1].tolist()


@pytest.mark.parametrize("text", ["", "\\", "\\\\<", "<s></s>[INST]<|x|>[/INST]", "<<SYS>>a<</SYS>>\\[INST]", "<<|", "<\\|"])
def test_escape(text):
    hidden = chat.escape(text)
    assert chat.unescape(hidden) == text
    assert not any(c in hidden for c in chat.CONTROL)


# --- 2 -----------------------------------------------------------------------------------


def test_targets(spark):
    sizes = {"a": 100, "b": 10, "c": 1000, None: 5, "d": 0}
    rows = mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
    weights = dict(zip(sorted(sizes, key=lambda s: (s is None, s)), [1, 2, 3, 1, 2]))
    target, open_ = {}, set(sizes)
    while open_:
        left = sum(sizes.values()) - sum(target.values())
        share = {s: left * weights[s] / sum(weights[o] for o in open_) for s in open_}
        full = {s for s in open_ if share[s] > 3 * sizes[s]}
        target |= {s: 3 * sizes[s] for s in full} if full else share
        open_ = open_ - full if full else set()
    assert {r["source"]: pytest.approx(r["target"]) for r in rows} == target


def test_mix_takes_near_the_target(spark):
    rows = [(i if i % 50 else 50, " ".join(["x"] * (i % 37)), f"s{i % 3}" if i % 5 else None, i % 4 + 1.0) for i in range(3000)]
    docs = spark.createDataFrame([*rows, (None, None, "s1", None)], "doc_id long, text string, source string, w double")
    plan = mixing.mix(docs, weight="w")
    taken = plan.collect()
    assert len(taken) == 3001 and all(0 <= r["taken"] <= 3 * r["size"] for r in taken)
    again = mixing.mix(docs.repartition(7), weight="w").collect()
    assert sorted(map(repr, taken)) == sorted(map(repr, again))
    sums = defaultdict(int)
    for r in taken:
        sums[r["source_size"], r["target"]] += r["taken"]
    assert all(abs(got - target) <= 3 for (_, target), got in sums.items())
    assert mixing.mixed(docs, plan).columns == docs.columns
    assert mixing.mix(docs.limit(0), weight="w").count() == 0


def test_mixed_rows_of_repeated_ids(spark):
    """Rows that share a null or repeated id are taken as often as the plan takes each of them."""
    rows = [(i if i % 3 else None if i % 2 else 7, " ".join(["x"] * (1 + i % 23)), f"s{i % 4 // 2}") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plan = mixing.mix(docs)
    wanted, got = defaultdict(int), defaultdict(int)
    for r in plan.collect():
        wanted[r["doc_id"], r["source"], r["size"]] += r["times"]
    for r in mixing.mixed(docs, plan).collect():
        got[r["doc_id"], r["source"], len(r["text"].split())] += 1
    assert got == {k: n for k, n in wanted.items() if n} and len(got) > 50


# --- 4 -----------------------------------------------------------------------------------

PAGES = [(3, "http://a/\r\n", "<p>x"), (1, None, "<p>x"), (2, "u", None), (5, "u", ""), (None, "n", "<p>x"), (8, "v", "é" * 70000)]


@pytest.mark.parametrize("compress", [True, False])
def test_archives(spark, compress):
    pages = spark.createDataFrame([(*p, 0) for p in PAGES], "page_id long, url string, html string, sha int")
    archives = warc.write_archives(pages, compress=compress, file_bytes=600)
    got = {r["record_id"]: r for r in warc.read_archives(archives).collect()}
    assert len(got) == len(PAGES) and {r["kind"] for r in got.values()} == {"record"}
    for key, _, html in PAGES:
        data, r = (html or "").encode(), got[warc.ID % key]
        first = min(k for k, _, h in PAGES if k is not None and (h or "") == (html or ""))
        assert (r["payload_bytes"], r["payload_digest"]) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())
        assert (r["record_type"], r["refers_to"]) == (("response", None) if key == first else ("revisit", warc.ID % first))
    assert warc.read_archives(warc.write_archives(pages.limit(0))).count() == 0


class Bytes:
    def __init__(self, data):
        self.data = data

    def size(self):
        return len(self.data)

    def read_at(self, n, at):
        return self.data[at : at + n]


@pytest.mark.parametrize("pack", [warc.gzipped, bytes])
@pytest.mark.parametrize("harm", ["flip", "cut out", "junk", "end", "nothing"])
def test_salvage(pack, harm):
    records = [pack(warc.record(i, f"u{i}", f"<p>{i} WARC/1.1 \x1f".encode() * 50, None, False)) for i in range(6)]
    starts = np.cumsum([0, *map(len, records)])
    data = b"".join(records)
    at = int(starts[2]) + len(records[2]) - 60
    damaged = {"flip": data[:at] + bytes([data[at] ^ 255]) + data[at + 1 :], "cut out": data[: at - 30] + data[at:],
               "junk": data[: starts[3]] + b"\x1f\x8b\x08junk WARC/9 " * 9 + data[starts[3] :], "end": data[:-40], "nothing": data}[harm]
    found = list(warc.salvage(warc.Window(Bytes(damaged))))
    ids = [h["warc-record-id"] for _, _, h, _, _ in found if h]
    lost = {"flip": [2], "cut out": [2], "junk": [], "end": [5], "nothing": []}[harm]
    assert ids == [warc.ID % i for i in range(6) if i not in lost]
    assert sum(n for _, n, _, _, _ in found) == len(damaged)  # records and gaps cover the file
    assert sum(h is None for _, _, h, _, _ in found) == (harm != "nothing")


# --- 5 -----------------------------------------------------------------------------------


def test_neighbours(spark, edge):
    got = minhash.compare_neighbours(edge).collect()
    rows = sorted(EDGE, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    hasher, expected = minhash.MinHasher(), []
    for (key, own), (_, after) in zip(rows, rows[1:] + rows[:1]):
        own, after = own or "", after or ""
        n = len(own) // 3
        edited = own[: len(own) - n] + after[:n]
        prints = minhash.hex_rows(hasher.signatures([own, edited]))
        expected.append((key, len(own), hashlib.sha256(edited.encode()).hexdigest(), *prints))
    assert sorted(repr(tuple(r)[:5]) for r in got) == sorted(map(repr, expected))
    assert minhash.compare_neighbours(edge.limit(0)).count() == 0
    assert minhash.fingerprints(edge).count() == len(EDGE)


def test_likeness():
    texts = [text_of(1, 300), text_of(1, 200) + " " + text_of(2, 100)]
    sets = []
    for t in texts:
        w = t.split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)})
    signs = minhash.MinHasher(2048).signatures(texts)
    assert (signs[0] == signs[1]).mean() == pytest.approx(len(sets[0] & sets[1]) / len(sets[0] | sets[1]), abs=0.04)


def test_near_duplicates(spark, edge):
    got = {(r["doc_id"], r["class_id"]) for r in minhash.near_duplicates(edge).collect()}
    assert {(1, 1), (2, 1), (3, 1), (11, 1), (None, 1), (4, 4), (5, 4), (6, 4), (7, 7), (9, 9), (10, 10)} <= got


@pytest.mark.parametrize(("bands", "places"), [(21, 6), (16, 1)])
def test_near_duplicates_in_chains(spark, monkeypatch, bands, places):
    """Texts that resemble the next one but not the one after it: one class, as brute force says.

    Also with bands of one place, in which unrelated texts meet.
    """
    monkeypatch.setattr(minhash, "BANDS", bands)
    monkeypatch.setattr(minhash, "ROWS", places)
    texts = {}
    for chain in range(4):
        words = [f"c{chain}w{i}" for i in range(700)]
        order = np.random.default_rng(chain).permutation(12).tolist()
        texts |= {100 * chain + k: " ".join(words[20 * at : 20 * at + 300]) for k, at in enumerate(order)}
    sets = {k: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} for k, t in texts.items() for w in [t.split()]}
    likeness = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets}
    root = {k: k for k in texts}
    for _ in texts:
        for (a, b), alike in likeness.items():
            if alike >= 0.8:
                root[a] = root[b] = min(root[a], root[b])
    got = {r["doc_id"]: r for r in minhash.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert {k: r["class_id"] for k, r in got.items()} == root and len(set(root.values())) == 4
    assert all(r["similarity"] == pytest.approx(likeness[k, r["class_id"]]) for k, r in got.items())


# --- 6, 9 --------------------------------------------------------------------------------


def test_quality(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text")
    labels = table(spark, "/root/testdata/sf0.01", "labels")
    model = quality.train(docs, labels.filter(id_bucket(labels["doc_id"], 4) != 2))
    held = labels.filter(id_bucket(labels["doc_id"], 4) == 2)
    rows = quality.score(docs, model).join(held, "doc_id").collect()
    good = [r["score"] for r in rows if r["quality"] == 1]
    bad = [r["score"] for r in rows if r["quality"] == 0]
    assert np.mean([g > b for g in good for b in bad]) > 0.85


def test_quality_of_odd_rows(spark, edge):
    labels = spark.createDataFrame([(1, 1), (1, 0), (7, 0), (None, 1), (5, None)], "doc_id long, quality int")
    rows = quality.score(edge, quality.train(edge, labels)).collect()
    assert len(rows) == len(EDGE) and all(0 <= r["score"] <= 1 for r in rows)
    assert {r["score"] for r in quality.score(edge, quality.train(edge, labels.limit(0))).collect()} == {0.5}


def test_language(spark, edge):
    docs = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text", "lang")
    model = langid.train(docs.filter(id_bucket(docs["doc_id"], 5) != 0))
    held = langid.predict(docs.filter(id_bucket(docs["doc_id"], 5) == 0), model).collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.95
    odd = langid.predict(edge, model).collect()
    assert len(odd) == len(EDGE) and all((r["lang_pred"] == "und") == (r["doc_id"] in (4, 5, 6)) for r in odd)
    kept = langid.keep_known(edge, model)
    assert kept.columns == edge.columns and kept.count() == len(EDGE) - 3
    nothing = langid.train(docs.limit(0))
    assert {r["lang_pred"] for r in langid.predict(edge, nothing).collect()} == {"und"}


# --- 7 -----------------------------------------------------------------------------------


def brute_roots(values, bits):
    root = list(range(len(values)))
    for _ in values:
        for i, x in enumerate(values):
            for j, y in enumerate(values):
                if (x ^ y).bit_count() <= bits:
                    root[i] = root[j] = min(root[i], root[j])
        if all(root[root[i]] == root[i] for i in range(len(root))):
            break
    return root


@pytest.mark.parametrize("bits,cell", [(2, 8), (3, 1024)])
def test_trie_join(spark, bits, cell):
    random = np.random.default_rng(bits)
    values = set()
    for base in random.integers(0, 2**63, 5).tolist():
        for _ in range(25):
            x = base
            for b in random.integers(0, 64, random.integers(0, 6)).tolist():
                x ^= 1 << b
            values.add(x)
    values = sorted(values)
    points = spark.createDataFrame([(i, x - 2**64 if x >> 63 else x) for i, x in enumerate(values)], "id long, fp long")
    roots = {r["node"]: r["root"] for r in components(simhash.links(points, bits, cell_rows=cell)).collect()}
    assert [roots.get(i, i) for i in range(len(values))] == brute_roots(values, bits)


def test_several_tries_and_check(spark):
    random = np.random.default_rng(7)
    rows = []
    for base in random.integers(0, 2**63, (6, 4)).tolist():
        for _ in range(20):
            rows.append([x ^ sum({1 << b for b in random.integers(0, 63, random.integers(0, 5)).tolist()}) for x in base])
    points = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id long, fp0 long, fp1 long, check2 long, check3 long")
    roots = {r["node"]: r["root"] for r in components(simhash.links(points, 2, 5, cell_rows=16)).collect()}

    def linked(x, y):
        bits = [(a ^ b).bit_count() for a, b in zip(x, y)]
        return min(bits[:2]) <= 2 and bits[2] + bits[3] <= 5

    root = list(range(len(rows)))
    for _ in rows:
        for i, x in enumerate(rows):
            for j, y in enumerate(rows):
                if linked(x, y):
                    root[i] = root[j] = min(root[i], root[j])
    assert [roots.get(i, i) for i in range(len(rows))] == root
    assert 6 < len(set(root)) < len(rows)


@pytest.mark.parametrize("copies", [0, 60])
def test_hot_fingerprint(spark, monkeypatch, copies):
    """Points of one trie fingerprint, and of one close to it, in pieces of bounded size and number."""
    random, rows, tables = np.random.default_rng(11), [], {}
    base, checks = int(random.integers(0, 2**62)), random.integers(0, 2**62, 6).tolist()
    for n in range(120 + copies):
        check = checks[n % 6] ^ sum({1 << b for b in random.integers(0, 62, n % 5).tolist()})
        rows.append((base ^ (5 if n >= 120 else 0), check))
    rows = list(dict.fromkeys(rows))

    def counted(df, name):
        table = written(df, name)
        tables[name] = max(tables.get(name, 0), table.count())
        return table

    monkeypatch.setattr(simhash, "written", counted)
    points = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id long, fp0 long, check1 long")
    roots = {r["node"]: r["root"] for r in components(simhash.links(points, 2, 5, cell_rows=32)).collect()}
    root = list(range(len(rows)))
    for _ in range(6):
        for i, x in enumerate(rows):
            for j, y in enumerate(rows):
                if (x[0] ^ y[0]).bit_count() <= 2 and (x[1] ^ y[1]).bit_count() <= 5:
                    root[i] = root[j] = min(root[i], root[j])
    assert [roots.get(i, i) for i in range(len(rows))] == root
    # every row once per block, or a few times per pair of ranges; without a look at the other side hundreds of times
    assert tables["cells"] < 40 * len(rows)


def test_hot_fingerprint_with_many_near(spark, monkeypatch):
    """Points of one fingerprint are not dealt again for each of many fingerprints near it, and past tables are removed."""
    random, rows, tables = np.random.default_rng(5), [], []
    base, other = (int(x) for x in random.integers(0, 2**62, 2))
    checks = random.integers(0, 2**62, 4).tolist()
    for n in range(400):
        # 200 points of one fingerprint, 40 of one a bit away, others of fingerprints one to three bits away, or of any
        flips = {1 << b for b in random.choice(62, n % 3 + 1, False).tolist()}
        fp = base if n < 200 else base ^ 1 if n < 240 else base ^ sum(flips) if n < 380 else other ^ sum(flips)
        rows.append((fp, checks[n % 4] ^ sum({1 << b for b in random.integers(0, 62, n % 6).tolist()})))
    rows = list(dict.fromkeys(rows))

    def counted(df, name):
        table = written(df, name)
        if name in ("rest", "cells"):
            tables.append((table.count(), table.inputFiles()[:1]))
        return table

    monkeypatch.setattr(simhash, "written", counted)
    points = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id long, fp0 long, check1 long")
    roots = {r["node"]: r["root"] for r in components(simhash.links(points, 2, 5, cell_rows=96)).collect()}
    root = list(range(len(rows)))
    for _ in range(8):
        for i, x in enumerate(rows):
            for j, y in enumerate(rows):
                if (x[0] ^ y[0]).bit_count() <= 2 and (x[1] ^ y[1]).bit_count() <= 5:
                    root[i] = root[j] = min(root[i], root[j])
    assert [roots.get(i, i) for i in range(len(rows))] == root
    assert 4 < len(set(root)) < len(rows)
    # the points of the fingerprint twice, once more per range; walked down the trie with all near them 1,000 times
    assert sum(n for n, _ in tables) < 20 * len(rows)
    assert not any(os.path.exists("/" + f.split(":", 1)[-1].lstrip("/")) for _, files in tables for f in files)


def edited(kind, words, other, share):
    n = max(1, int(len(words) * share))
    if kind == "substituted":
        out = list(words)
        for i in np.random.default_rng(len(words)).choice(len(words), n, False):
            out[i] = other[i % len(other)]
        return out
    middle = len(words) // 2
    return {"appended": words + other[:n], "cut": words[:-n], "inserted": words[:middle] + other[:n] + words[middle:],
            "prepended": other[:n] + words}[kind]


def test_near_copies_by_kind_of_edit(spark):
    """The near-dedup stage finds what brute-force Jaccard finds, whatever the edit."""
    import corpus_pipeline

    docs = table(spark, "/root/testdata/sf0.01", "documents").select("text").distinct().orderBy("text").collect()
    texts = [w for r in docs if 60 <= len(w := (r["text"] or "").lower().split()) <= 600]
    kinds = {"substituted": 0.02, "appended": 0.17, "cut": 0.16, "inserted": 0.13, "prepended": 0.17}
    rows, wanted = [], defaultdict(list)

    def shingles(w):
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    for n, words in enumerate(texts[:200]):
        kind = list(kinds)[n % 5]
        copy = edited(kind, words, texts[-1 - n], kinds[kind])
        a, b = shingles(words), shingles(copy)
        if len(a & b) >= 0.8 * len(a | b):
            wanted[kind].append((2 * n, 2 * n + 1))
        rows += [(2 * n, " ".join(words), "en", "s", 1), (2 * n + 1, " ".join(copy), "en", "s", 1)]
    made = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r["doc_id"] for r in corpus_pipeline.one_of_each(spark, made, DATA).select("doc_id").collect()}
    for kind, pairs in wanted.items():
        assert len(pairs) >= 20 and sum(b not in kept for _, b in pairs) >= 0.9 * len(pairs), kind


def test_random_points_cost_in_proportion():
    """Twice the points of a random trie cost about twice the time, at the budget of the near-dedup stage."""
    import time

    import corpus_pipeline

    def seconds(n):
        values = np.sort(np.random.default_rng(n).integers(0, 2**63, n).astype(np.uint64))
        none = np.zeros(n, np.int64)
        best = 9.0
        for _ in range(2):
            start = time.process_time()
            simhash.trie_links(values, none, none, none, np.full(n, corpus_pipeline.NEAR_BITS), simhash.Forest(np.arange(n)))
            best = min(best, time.process_time() - start)
        return best

    assert seconds(160_000) <= 2.4**2 * seconds(40_000)


def test_window_fingerprints():
    kind = simhash.Fingerprint(1, count=6, window=24)
    words = text_of(5, 300).split()
    own = simhash.fingerprint(" ".join(words), kind)
    assert len(set(own)) > 3 and simhash.fingerprint("", kind) == simhash.fingerprint(None, kind) == [0] * 6
    for other in (words + text_of(6, 40).split(), words[40:], text_of(7, 40).split() + words):
        assert sum(a == b for a, b in zip(own, simhash.fingerprint(" ".join(other), kind))) >= 3
    assert simhash.fingerprint("One", kind) == simhash.fingerprint("one", kind) and len(set(simhash.fingerprint("one", kind))) == 1


def test_fingerprints_of_one_text():
    text = "The river runs along seven quiet villages until it meets the broad northern harbour at night"
    several = simhash.fingerprint(text, simhash.Fingerprint(3, count=4))
    assert several[0] == simhash.fingerprint(text, simhash.Fingerprint(3))[0] and len(set(several)) == 4
    assert simhash.fingerprint(None, simhash.Fingerprint(5, 6, 3)) == [0, 0, 0]
    long = simhash.Fingerprint(1, 6, 2)
    assert simhash.fingerprint(text, long) == simhash.fingerprint(" ".join(reversed(text.split())), long)


def test_simhash(spark, edge):
    import xxhash

    def plain(text):
        words = (text or "").encode().lower().split()
        hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))] if words else []
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    rows = simhash.classes(edge.select("doc_id", "text")).collect()
    prints = {k: plain(t) for k, t in EDGE}
    assert all(r["fp"] % 2**64 == prints[r["doc_id"]] for r in rows) and len(rows) == len(EDGE)
    classes = {r["doc_id"]: r["component_id"] for r in rows}
    assert classes[2] == classes[None] == classes[11] == 1 and classes[4] == classes[5] == classes[6] == 4
    kept = simhash.representatives(edge, simhash.classes(edge))
    ids = [r["doc_id"] for r in kept.collect()]
    assert kept.columns == edge.columns and len(ids) == len(set(ids)) and set(ids) == {c for c in classes.values()}
    assert simhash.classes(edge.limit(0)).count() == 0


def test_representatives_of_repeated_ids(spark):
    """Rows of one id and unrelated texts are classes of their own; a copy goes although its id stays elsewhere."""
    rows = [(1, text_of(1)), (1, text_of(2)), (0, text_of(3)), (5, text_of(4)), (5, text_of(3)), (7, "one"), (7, "one")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = simhash.representatives(docs, simhash.classes(docs)).collect()
    assert sorted(map(tuple, kept)) == sorted({*rows} - {(5, text_of(3))})


# --- 8 -----------------------------------------------------------------------------------


def test_urls(spark):
    rules = [urls.Rule("allow", "org", "/"), urls.Rule("block", "a.org", "/x/"), urls.Rule("block", "com", "/ads")]
    rows = [(1, "http://B.a.org/x/1?q"), (2, "HTTPS://A.ORG"), (3, "http://a.org/x"), (4, None), (5, "a.org/x/"), (6, "http://xa.org/x/"),
            (7, "http://c.com/ads#f"), (8, "http://c.com?/ads"), (9, ""), (9, "")]
    pages = spark.createDataFrame([(*r, "h") for r in rows], "page_id long, url string, host string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge(pages, rules).collect()}
    assert got[1] == ("b.a.org", "/x/1", "a.org/x/", "block") and got[2][:3] == ("a.org", "", None)
    assert got[3] == ("a.org", "/x", "org/", "allow") and got[4][:3] == got[5][:3] == got[9][:3] == ("", "", None)
    assert got[6][2] == "org/" and got[7] == ("c.com", "/ads", "com/ads", "block") and got[8][:3] == ("c.com", "", None)
    assert all(v[3] in ("allow", "block") for v in got.values())
    assert urls.judge(pages.limit(0), rules).count() == 0
    assert {r["verdict"] for r in urls.judge(pages, []).collect()} == {"allow"}


def test_trees():
    random = np.random.default_rng(3)
    x = random.normal(size=(4000, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 2] > 0.5)).astype(float)
    trees = urls.fit(x[:3000], y[:3000])
    assert ((trees.margin(x[3000:]) > 0) == y[3000:]).mean() > 0.95


# --- 10 ----------------------------------------------------------------------------------


def smallest_distance(item, text):
    row = list(range(len(item) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for i, p in enumerate(item, 1):
            new.append(min(new[-1] + 1, row[i] + 1, row[i - 1] + (p != c)))
        row = new
        best = min(best, row[-1])
    return best


def test_decontamination(spark):
    random = np.random.default_rng(4)
    items = [(1, text_of(100, 12)), (2, text_of(101, 30)), (3, "short"), (4, None), (5, text_of(100, 12))]
    docs = []
    for i in range(60):
        item = items[i % 2][1]
        changed = list(item)
        for _ in range(random.integers(0, 9)):
            k = int(random.integers(0, len(changed)))
            changed[k : k + int(random.integers(0, 2))] = random.choice(list("abc xyz"), int(random.integers(0, 2)))
        docs.append((i, text_of(i, 30) + " " + "".join(changed).upper() + "!\n" + text_of(i + 500, 30)))
    docs += [(100, None), (101, ""), (102, "too short!"), (103, "shorter"), (103, "shorter")]
    df = spark.createDataFrame([(*d, 0) for d in docs], "doc_id long, text string, distance int")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    expected = set()
    for key, text in docs:
        for item, words in items:
            if plain := decontaminate.normal(words):
                d = smallest_distance(plain, decontaminate.normal(text))
                if d <= decontaminate.budget_of(plain, decontaminate.RATE):
                    expected.add((key, item, d))
    for block in (decontaminate.BLOCK_CHARS, 10):
        got = decontaminate.contaminated(df, benchmark, block_chars=block)
        assert {tuple(r)[:3] for r in got.collect()} == expected
        clean = decontaminate.clean(df, benchmark, block_chars=block)
        assert sorted(r["doc_id"] for r in clean.collect()) == sorted(k for k, _ in docs if k not in {e[0] for e in expected})
    assert {0, 1} < {d for _, _, d in expected} and decontaminate.contaminated(df, benchmark.limit(0)).count() == 0


# --- pipeline ----------------------------------------------------------------------------


def test_pipeline(spark):
    import __spark_entry__ as entry
    import corpus_pipeline

    docs = table(spark, DATA, "documents")
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        empty = stage(spark, docs.limit(0), DATA)
        assert empty.columns == docs.columns and empty.count() == 0
    rows = entry.queries()["pipeline"](spark, DATA).orderBy("start").collect()
    assert rows and [r["doc_id"] for r in rows] == sorted(r["doc_id"] for r in rows)
    assert [r["start"] for r in rows] == np.cumsum([0, *(r["n_tokens"] for r in rows)])[:-1].tolist()
    assert zlib.crc32(b"") == 0 and all(r["ids_crc32"] >= 0 for r in rows)
