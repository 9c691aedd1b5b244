"""Connected components of a graph of links, distributed: alternating large and small stars.

Each round points every node's larger neighbours at the smallest node it knows, then its
smaller ones. Minima are partial aggregates, so a node with very many links costs a join
that adaptive execution can split, never a gathered group. Links are first thinned to a
spanning forest inside each partition by union-find. Nothing but two numbers a round goes
to the driver, and every round is checkpointed to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewake.session import shared_folder

#: Links that one partition thins at a time.
FOREST_LINKS = 1 << 20


class UnionFind:
    """Union by smaller root over hashable nodes."""

    def __init__(self):
        self.parent: dict = {}

    def find(self, x):
        root = x
        while (up := self.parent.get(root, root)) != root:
            root = up
        while (up := self.parent.get(x, x)) != root:
            self.parent[x] = root
            x = up
        return root

    def union(self, a, b) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        if b < a:
            a, b = b, a
        self.parent[b] = a
        self.parent.setdefault(a, a)
        return True


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out(uf: UnionFind) -> pa.RecordBatch:
        nodes = [x for x in uf.parent if uf.find(x) != x]
        return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([uf.find(x) for x in nodes], pa.int64())], names=["a", "b"])

    uf = UnionFind()
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            uf.union(a, b)
        if len(uf.parent) > FOREST_LINKS:
            yield out(uf)
            uf = UnionFind()
    yield out(uf)


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(a, b) links of long nodes to (node, component), the component's smallest node.

    Nodes that only link to themselves, or to null, don't appear.
    """
    shared_folder(links.sparkSession)
    edges = links.filter(F.col("a") != F.col("b")).select("a", "b").mapInArrow(_forest, "a long, b long").distinct().checkpoint()
    mark = None
    for _ in range(most_rounds):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter(F.col("a") != F.col("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        edges = small.filter(F.col("a") != F.col("b")).distinct().checkpoint()
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == tuple(now):
            break
        mark = tuple(now)
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def local_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Component label (its smallest index) of each of n nodes, for links inside one task."""
    label = np.arange(n)
    if not len(a):
        return label
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new
