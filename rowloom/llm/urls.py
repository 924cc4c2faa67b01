"""URL filter: rules first, gradient-boosted trees on lexical features for the rest.

A rule is a host and the beginning of a path. It fits its host and all subdomains; of those that fit, the longest
wins. URLs that a rule decides are the labelled URLs: a boosted ensemble of small trees learns from them to block
or allow, from the length, depth, digits, entropy, parameters and other marks of a URL, and from statistics of its host
suffix (the last two labels): how many URLs have it, and how many of those with a label are blocked. The
statistics are counted over all rows; the trees learn from at most ``sample`` labelled rows, half of each verdict.

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; path: then up to ``?``, ``#`` or
the end. Defined results: a null URL or one without ``://`` has an empty host and path, fits no rule and is judged
by the trees; without labelled URLs everything is allowed, with one verdict only that is the verdict for all. Of rules of
equal length that fit, the last of the list counts. URLs of any length are taken whole. Repeated ids are judged row by
row. An empty table gives no rows. Columns other than id and URL are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowloom.llm.components import written
from rowloom.llm.text import map_batches
from rowloom.session import checked_broadcast

ALLOW, BLOCK = "allow", "block"
SAMPLE = 20_000
TREES, DEPTH, BINS, RATE = 40, 3, 32, 0.3
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str  # begins with a slash

    @property
    def text(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    found = F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), F.lit(""))
    return F.translate(found, UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matched_rule(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, or null."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.text)):  # the longest comes out as the first condition
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        text = F.when(fits, rule.text).otherwise(text)
        verdict = F.when(fits, rule.verdict).otherwise(verdict)
    return text, verdict


def suffix_of(host: Column) -> Column:
    return F.substring_index(host, ".", -2)


def lexical(url: str) -> tuple[float, ...]:
    """Features of the URL alone."""
    rest = url.partition("://")[2]
    before, _, query = rest.partition("#")[0].partition("?")
    host, _, path = before.partition("/")
    counts = Counter(url)
    n = len(url)
    entropy = -sum(c / n * math.log2(c / n) for c in counts.values()) if n else 0.0
    digits = sum(c.isdigit() for c in url)
    steps = [s for s in path.split("/") if s]
    last = steps[-1] if steps else ""
    return (
        n, len(host), len(path), len(steps), digits / n if n else 0.0, entropy,
        len([p for p in query.split("&") if p]), host.count("."), url.count("-"), url.count("%"),
        sum(c.isdigit() for c in host), float("#" in url), float("." in last), float(path.endswith("/")),
        float(url.startswith("https")), len(steps[0]) if steps else 0, float(sum(map(ord, steps[0])) % 97) if steps else -1.0,
    )


@dataclass(frozen=True)
class Trees:
    """Complete binary trees: feature, threshold and value arrays, one row per tree."""

    start: float
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def margin(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        inner = self.feature.shape[1]
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf):
            at = np.zeros(len(x), np.int64)
            while len(at) and at[0] < inner:
                at = 2 * at + 1 + (x[np.arange(len(x)), feature[at]] > threshold[at])
            total += leaf[at - inner]
        return total


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, rate: float = RATE) -> Trees:
    """Boosted trees for the log-odds of ``y`` (0 or 1), with histograms of second-order gradients."""
    inner = 2**depth - 1
    share = min(max(float(y.mean()) if len(y) else 0.0, 1e-6), 1 - 1e-6)
    start = math.log(share / (1 - share))
    empty = Trees(start, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)))
    if not len(y) or y.min() == y.max():
        return empty
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    margin = np.full(len(y), start)
    features, thresholds, leaves = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        at = np.zeros(len(y), np.int64)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for node in range(inner):
            rows = np.flatnonzero(at == node)
            best = 1e-6
            for f, edge in enumerate(edges):
                if not len(rows) or not len(edge):
                    continue
                gs = np.cumsum(np.bincount(binned[rows, f], g[rows], len(edge) + 1))
                hs = np.cumsum(np.bincount(binned[rows, f], h[rows], len(edge) + 1))
                gain = gs[:-1] ** 2 / (hs[:-1] + 1) + (gs[-1] - gs[:-1]) ** 2 / (hs[-1] - hs[:-1] + 1) - gs[-1] ** 2 / (hs[-1] + 1)
                k = int(gain.argmax())
                if gain[k] > best:
                    best, feature[node], threshold[node] = float(gain[k]), f, edge[k]
            at[rows] = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
        place = at - inner
        leaf = rate * np.bincount(place, g, inner + 1) / (np.bincount(place, h, inner + 1) + 1)
        margin += leaf[place]
        features.append(feature)
        thresholds.append(threshold)
        leaves.append(leaf)
    return Trees(start, np.array(features), np.array(thresholds), np.array(leaves))


def _features(rows: DataFrame) -> DataFrame:
    """``rows`` with an array of all features; no shuffle."""
    kept = rows.columns

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            url = batch.column(kept.index("url")).to_pylist()
            pages = batch.column(kept.index("suffix_rows")).to_pylist()
            blocked = batch.column(kept.index("suffix_blocked")).to_pylist()
            made = [[*lexical(u or ""), math.log1p(n or 0), b] for u, n, b in zip(url, pages, blocked)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.list_(pa.float64()))], names=[*kept, "features"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return map_batches(rows, work, f"{fields}, features array<double>")


def judge(pages: DataFrame, rules: list[Rule], key: str = "page_id", url: str = "url", sample: int = SAMPLE,
          seed: int = 8) -> DataFrame:
    """``(key, host, path, rule, verdict, block_score)`` of every row."""
    col = F.col("url")
    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("url")).withColumns({"host": host_of(col), "path": path_of(col)})
    text, verdict = matched_rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": text, "ruled": verdict, "suffix": suffix_of(F.col("host"))})
    # Per suffix, over all rows. The sums are made per task before the shuffle, so a common suffix is no burden.
    is_block = F.when(F.col("ruled") == BLOCK, 1).when(F.col("ruled") == ALLOW, 0)
    statistics = rows.groupBy("suffix").agg(
        F.count(F.lit(1)).alias("suffix_rows"),
        ((F.coalesce(F.sum(is_block), F.lit(0)) + 1) / (F.count(is_block) + 2)).alias("suffix_blocked"),
    )
    counted = rows.join(checked_broadcast(written(statistics, "suffixes")), "suffix")
    place = F.xxhash64(F.coalesce(F.col("url"), F.lit("")), F.lit(seed))
    training = None
    for value in (ALLOW, BLOCK):  # chosen by their URLs, so that only the chosen ones need features
        part = counted.filter(F.col("ruled") == value).select("ruled", "url", "suffix_rows", "suffix_blocked", place.alias("place"))
        part = part.orderBy("place", "url").limit(sample // 2)
        training = part if training is None else training.unionByName(part)
    learned = _features(training).select("ruled", "features", "place").collect()
    known = _features(counted)
    learned.sort(key=lambda r: (r["place"], r["ruled"], r["features"]))
    x = np.array([r["features"] for r in learned], np.float64).reshape(len(learned), len(lexical("")) + 2)
    trees = fit(x, np.array([r["ruled"] == BLOCK for r in learned], np.float64))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column(5).to_pylist(), np.float64).reshape(batch.num_rows, -1)
            score = 1 / (1 + np.exp(-trees.margin(x)))
            ruled = batch.column(4).to_pylist()
            verdicts = [r or (BLOCK if s >= 0.5 else ALLOW) for r, s in zip(ruled, score)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:4], pa.array(verdicts, pa.string()), pa.array(score)],
                names=["key", "host", "path", "rule", "verdict", "block_score"],
            )

    kind = pages.schema[key].dataType.simpleString()
    out = map_batches(known.select("key", "host", "path", "rule", "ruled", "features"), work,
                      f"key {kind}, host string, path string, rule string, verdict string, block_score double")
    return out.withColumnRenamed("key", key)
