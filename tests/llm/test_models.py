"""Signatures and models against plain versions of themselves, and their memory on hard texts."""

import re
import resource
import subprocess
import sys

import numpy as np
import pytest

from rowloom.llm import langid, minhash, quality, urls
from rowloom.llm.text import SpanHasher, mix

TEXTS = ["", "one", "One two THREE four", "a b c d e f g a b c d e", " \n\t", "é ü\x0bx y  z w", "The quick brown fox jumps over it"]


# --- 5: minima over Python sets -----------------------------------------------------------


def plain_signature(text, hasher):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    if not words:
        return [0xFFFF] * len(hasher.a)
    span = min(5, len(words))
    spans, hashes = SpanHasher(), []
    for i in range(len(words) - span + 1):
        total = 0
        for k, word in enumerate(words[i : i + span]):
            points = np.array([ord(c) for c in word], np.uint32)
            own = int(spans(points, np.array([0]), np.array([len(points)]))[0])
            total = (total + own * int(hasher.place[k])) % 2**64
        hashes.append(int(mix(np.array([total], np.uint64))[0]))
    return [min((x * int(a) + int(b)) % 2**64 for x in set(hashes)) >> 32 & 0xFFFF for a, b in zip(hasher.a, hasher.b)]


def test_signatures_are_minima_over_sets():
    hasher = minhash.MinHasher(permutations=16)
    got = hasher.signatures(TEXTS)
    assert got.tolist() == [plain_signature(t, hasher) for t in TEXTS]


# --- 6: bag average and one step of gradient descent --------------------------------------


def test_one_step_of_gradient_descent():
    """Two texts, one epoch: the weights are those of the formulas written out."""
    rng = np.random.default_rng(3)
    bags = [{int(i): int(n) for i, n in zip(rng.choice(64, 9, False), rng.integers(1, 5, 9))} for _ in range(2)]
    ids = [np.array(sorted(b), np.int32) for b in bags]
    shares = [np.array([b[i] for i in sorted(b)], np.float32) / sum(b.values()) for b in bags]
    model = quality.descend(ids, shares, np.array([1.0, 0.0]), buckets=64, width=4, epochs=1, rate=0.3, seed=6)

    random = np.random.default_rng(6)
    table = (random.random((64, 4), np.float32).astype(np.float64) - 0.5) / 4
    out, bias = np.zeros((4, 2)), np.zeros(2)
    for step, i in enumerate(random.permutation(2).tolist()):
        speed = 0.3 * (1 - step / 2)
        total = sum(bags[i].values())
        mean = sum(n / total * table[row] for row, n in bags[i].items())
        chance = np.exp(mean @ out + bias)
        chance /= chance.sum()
        chance[1 - i] -= 1  # the label of text 0 is 1
        back = out @ chance
        out -= speed * np.outer(mean, chance)
        bias -= speed * chance
        for row, n in bags[i].items():
            table[row] -= speed * min(1, n / total * len(bags[i])) * back
    assert np.allclose(model.weights, table @ (out[:, 1] - out[:, 0]), atol=1e-6)
    assert model.bias == pytest.approx(bias[1] - bias[0], abs=1e-6)


def test_scores_are_averages_of_weights():
    hasher = SpanHasher()
    model = quality.QualityModel(np.random.default_rng(1).normal(size=1 << 10), 0.25)
    scores = model.scores(TEXTS, hasher)
    for text, score in zip(TEXTS, scores):
        rows, _ = quality.features([text], hasher, 1 << 10)
        mean = sum(model.weights[r] for r in rows) / len(rows) if len(rows) else 0.0
        assert score == pytest.approx(1 / (1 + np.exp(-(mean + 0.25))))


def test_training_is_bounded_and_repeats(spark):
    rows = [(i % 60 if i % 7 else None, f"w{i % 13} w{i % 5} " * (1 + i % 9)) for i in range(300)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, place int")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)] + [(None, 1, 0), (3, None, 0), (5, 7, 0)], "doc_id long, quality int, text int")
    models = [quality.train(d, labels, buckets=1 << 10, entries=n) for d, n in ((docs, 400), (docs.repartition(7), 400), (docs, 1 << 20))]
    assert (models[0].weights == models[1].weights).all() and models[0].bias == models[1].bias
    assert (models[0].weights != models[2].weights).any()
    assert quality.score(docs.limit(0), models[0]).count() == 0


# --- 8: a tree by exhaustive splits --------------------------------------------------------


def plain_tree(x, g, h, depth, edges):
    """The predictions of one tree whose every split is the best of all features and edges."""
    def leaf(rows):
        return g[rows].sum() / (h[rows].sum() + 1)

    def grow(rows, level):
        if level == depth:
            return {r: leaf(rows) for r in rows}
        best, cut = 1e-6, None
        for f in range(x.shape[1]):
            for edge in edges[f]:
                low = x[rows, f] <= edge
                parts = rows[low], rows[~low]
                gain = sum(g[p].sum() ** 2 / (h[p].sum() + 1) for p in parts) - g[rows].sum() ** 2 / (h[rows].sum() + 1)
                if gain > best + 1e-12:
                    best, cut = gain, parts
        if cut is None:
            return grow(rows, level + 1)
        return {k: v for p in cut for k, v in (grow(p, level + 1) if len(p) else {}).items()}

    return grow(np.arange(len(x)), 0)


@pytest.mark.parametrize("seed", range(5))
def test_one_tree_is_that_of_exhaustive_splits(seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(80, 3)).round(1)
    y = ((x[:, 0] > 0.3) ^ (rng.random(80) < 0.2)).astype(float)
    trees = urls.fit(x, y, trees=1, depth=3, bins=8, rate=0.5)
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, 9)[1:-1])) for f in range(3)]
    p = np.full(80, y.mean())
    plain = plain_tree(x, y - p, p * (1 - p), 3, edges)
    start = np.log(y.mean() / (1 - y.mean()))
    assert np.allclose(trees.margin(x), [start + 0.5 * plain[i] for i in range(80)])


# --- 9: bundle and cosine ------------------------------------------------------------------


def plain_bundle(text, space):
    letters = [c.lower() if len(c.lower()) == 1 else c for c in text]
    total = np.zeros(space.dimensions)
    blank = space._vector(0).astype(int)
    for i, c in enumerate(letters):
        if not text[i].isalpha():
            continue
        around = []
        for k in (i - 1, i, i + 1):
            inside = 0 <= k < len(text) and text[k].isalpha()
            around.append(space._vector(ord(letters[k])).astype(int) if inside else blank)
        total += np.roll(around[0], 2) * np.roll(around[1], 1) * around[2]
    return total


@pytest.mark.parametrize("rows", [1 << 15, 3])
def test_bundles_and_cosines(monkeypatch, rows):
    monkeypatch.setattr(langid, "VECTOR_ROWS", rows)
    space = langid.LetterSpace(64, 9)
    texts = [*TEXTS, "日本語 テキスト", "ÄÖÜ äöü İi", "a"]
    plain = np.array([plain_bundle(t, space) for t in texts])
    assert (space.bundle(texts) == plain).all()
    group = np.arange(len(texts)) % 3
    assert (space.bundle(texts, group, 3) == [plain[group == g].sum(axis=0) for g in range(3)]).all()
    prototypes = np.random.default_rng(2).normal(size=(3, 64))
    prototypes /= np.linalg.norm(prototypes, axis=1, keepdims=True)
    model = langid.LanguageModel(("de", "en", "fr"), prototypes, 9)
    for vector, (name, score) in zip(plain, langid.judge(model, space, texts)):
        if not vector.any():
            assert (name, score) == ("und", 0.0)
            continue
        cosines = prototypes @ vector / np.linalg.norm(vector)
        assert name == model.languages[int(cosines.argmax())] and score == pytest.approx(min(max(cosines.max(), 0), 1))


HAN = """
import resource, sys
sys.path.insert(0, {root!r})
import numpy as np
from rowloom.llm import langid
points = np.random.default_rng(1).integers(0x4E00, 0x9FA5, 2_000_000).astype("<u4")
space = langid.LetterSpace(langid.DIMENSIONS, 9)
space.bundle([points.tobytes().decode("utf-32-le")])
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)
"""


def test_memory_on_two_million_han_letters():
    root = __file__.rsplit("/tests/", 1)[0]
    out = subprocess.run([sys.executable, "-c", HAN.format(root=root)], capture_output=True, text=True, timeout=300, check=True)
    assert int(out.stdout) < 1000 and resource is not None
