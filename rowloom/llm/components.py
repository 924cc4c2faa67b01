"""Connected components of links, as rounds of joins and sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.session import remove, scratch_path, short_shuffles


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, safe from lost executors."""
    return written_at(df, name)[0]


def written_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` as a table in the shared folder, and its path."""
    path = scratch_path(df.sparkSession, name)
    with short_shuffles(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def discard(df: DataFrame, paths: list[str]) -> None:
    """Remove tables in the shared folder that nothing reads any more."""
    for path in paths:
        remove(df.sparkSession, path)


def components(links: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``links(a, b)`` that is linked to another; the root is the smallest reachable.

    Alternating stars: in each round every node first hands its larger neighbours, then its smaller ones, to the smallest
    node it knows. Both steps keep the components, and the links end as stars around the smallest nodes. That takes
    rounds in the order of the logarithm of the nodes, whatever the order of ids in a chain (7 for a shuffled chain of
    100 nodes, 12 for 10,000). The smallest neighbour is found by sums per task first; the join that
    hands it out meets one row per node on that side, so that Spark can split a node with very many links. Tables
    of past rounds are removed. Links of a node with itself, and links to null, say nothing; repeated links count
    once; without links there are no rows.
    """
    pair = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]
    edges, old = written_at(links.filter("a != b").select(*pair).distinct(), "links")
    while True:
        ends = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(
            edges.select(F.col("b").alias("node"), F.col("a").alias("other")))
        nodes, nodes_path = written_at(ends.groupBy("node").agg(
            F.min("other").alias("near"), F.count_if(F.col("other") < F.col("node")).alias("below"),
            F.max(F.col("other") > F.col("node")).alias("above")), "nodes")
        if nodes.filter("below > 1 or (below = 1 and above)").isEmpty():
            # stars: every node but the smallest of a component knows that one alone
            return nodes.select("node", F.least("node", "near").alias("root"))
        smallest = nodes.select(F.col("node").alias("a"), F.least("node", "near").alias("low"))
        large, large_path = written_at(edges.join(smallest, "a").select(F.col("low").alias("a"), "b").distinct(), "large")
        least = large.groupBy("b").agg(F.min("a").alias("low"))
        handed = large.join(least, "b").filter("a != low").select(F.col("low").alias("x"), F.col("a").alias("y"))
        small = handed.unionByName(least.select(F.col("low").alias("x"), F.col("b").alias("y")))
        edges, new = written_at(small.select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "links")
        discard(edges, [old, nodes_path, large_path])
        old = new
