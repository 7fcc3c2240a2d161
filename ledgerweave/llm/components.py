"""Connected components of an edge table, at any size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerweave.llm.common import partitions, written

#: Edges that one task takes in the end; a larger table is first contracted in rounds.
ONE_TASK = 1_000_000

EDGES = "a long, b long"


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node with the smallest node of its component, by union-find."""
    node, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent = list(range(len(node)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x, y in zip(flat[: len(a)].tolist(), flat[len(a) :].tolist(), strict=True):
        x, y = root(x), root(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    return node, node[[root(x) for x in range(len(node))]] if len(node) else node


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The partition's edges as stars around the smallest node of each part; nothing else is kept of them."""
    kept_a, kept_b = np.empty(0, np.int64), np.empty(0, np.int64)
    for batch in batches:
        a = np.concatenate([kept_a, batch["a"].to_numpy(zero_copy_only=False)])
        b = np.concatenate([kept_b, batch["b"].to_numpy(zero_copy_only=False)])
        node, root = forest(a, b)
        kept_a, kept_b = node[node != root], root[node != root]
    yield pa.record_batch([pa.array(kept_a), pa.array(kept_b)], names=["a", "b"])


def connected_components(edges: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """node, component (its smallest node) for every node of ``edges`` (columns a, b: long, no nulls).

    Partitions reduce their edges to forests first, so repeated edges and hot
    nodes cost one row a partition.  While more than ``one_task`` edges are
    left, rounds of large-star and small-star (which keep components and lower
    every node's neighbour) and renewed local contraction shrink them; the rest
    is finished by union-find in one task of bounded size.
    """
    spark = edges.sparkSession
    edges = written(edges.select("a", "b").mapInArrow(_contract, EDGES), "edges")
    before = -1
    while (n := edges.count()) > one_task:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.unionByName(low.filter("m < a").select("a", F.col("m").alias("b"))).distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b")
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a > b").unionByName(low.select("a", F.col("m").alias("b")))
        edges = written(small.distinct().repartition(partitions(spark), "b").mapInArrow(_contract, EDGES), "edges")
        if n == before and edges.groupBy("a").count().filter("count > 1").isEmpty() and edges.join(edges.select(F.col("a").alias("b")), "b", "left_semi").isEmpty():
            break  # stars already: every node has one neighbour, which has none of its own
        before = n
    else:
        edges = written(edges.coalesce(1).mapInArrow(_contract, EDGES), "edges")
    labels = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return labels.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
