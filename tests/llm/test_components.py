"""Components against union-find, with counted rounds."""

import math
import os

import numpy as np
import pytest

from rowloom.llm import components as module
from rowloom.llm.components import components


def union_find(pairs):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None and a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {x: find(x) for x in list(root)}


def chain(n, seed):
    ids = np.random.default_rng(seed).permutation(n).tolist()
    return list(zip(ids[:-1], ids[1:]))


def star(n, center):
    return [(center, i) for i in range(n) if i != center]


def tree(n, seed):
    rng = np.random.default_rng(seed)
    ids = rng.permutation(n).tolist()
    return [(ids[i], ids[int(rng.integers(0, i))]) for i in range(1, n)]


GRAPHS = {
    "chain": chain(100, 1), "sorted": [(i, i + 1) for i in range(200)], "star": star(3000, 2999), "first": star(3000, 0),
    "tree": tree(500, 2), "ring": [*chain(64, 3), (chain(64, 3)[0][0], chain(64, 3)[-1][1])],
    "mixed": [(1, 2), (2, 1), (1, 2), (5, 5), (None, 4), (7, None), (None, None), (-3, 2), (9, 8)], "none": [],
}


@pytest.mark.parametrize("name", GRAPHS)
def test_components(spark, monkeypatch, name):
    rounds = []
    write = module.written_at
    monkeypatch.setattr(module, "written_at", lambda df, kind: (rounds.append(kind), write(df, kind))[1])
    pairs = GRAPHS[name]
    got = components(spark.createDataFrame(pairs, "a long, b long").repartition(3)).collect()
    expected = union_find(pairs)
    assert sorted((r["node"], r["root"]) for r in got) == sorted(expected.items())
    assert rounds.count("large") <= max(1, 2 * math.log2(max(2, len(expected))))


def test_long_chain(spark, monkeypatch):
    kept = []
    write = module.written_at
    monkeypatch.setattr(module, "written_at", lambda df, kind: (made := write(df, kind), kept.append((kind, made[1])))[0])
    links = spark.createDataFrame(chain(10_000, 4), "a long, b long")
    found = components(links)
    assert found.filter("root != 0").isEmpty() and found.count() == 10_000
    assert sum(kind == "large" for kind, _ in kept) <= 2 * math.log2(10_000)
    left = [path for _, path in kept if os.path.exists(path.removeprefix("file://").removeprefix("file:"))]
    assert len(left) <= 2  # tables of past rounds are gone
