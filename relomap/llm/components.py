"""Connected components: by alternating large-star and small-star rounds over an edge table, or, of few edges, in a task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relomap.llm.common import forget, lean, written

#: Edges of which one task finds the components by union-find, in some tens of megabytes; more are contracted by rounds.
FEW = 500_000


class Forest:
    """Union-find over the numbers 0 to n - 1, smaller roots first."""

    def __init__(self, n: int) -> None:
        self.parent = list(range(n))

    def root(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True

    def roots(self) -> np.ndarray:
        return np.array([self.root(x) for x in range(len(self.parent))], dtype=np.int64)


    def span(self, near: np.ndarray, left: np.ndarray, right: np.ndarray, known: np.ndarray) -> list[tuple[int, int]]:
        """Join the pairs that ``near`` marks (left by right); returns those that joined two trees.

        ``known`` holds a root for each number, perhaps an old one; rows whose pairs are known to be joined cost no loop.
        """
        out = []
        for x, p in enumerate(left.tolist()):
            others = right[near[x]]
            for q in others[known[others] != known[p]].tolist():
                if self.join(p, q):
                    out.append((p, q))
            known[others] = known[p] = self.root(p)
        return out


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link each node's larger (or, for small stars, smaller) neighbours to the least of its neighbourhood."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        both = both.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    linked = both.join(least, "u")
    if large:
        out = linked.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:  # each node of a small star is its own neighbour as well
        out = linked.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All edges to the rows ``node``, ``root`` of their components."""
    parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    if not parts:
        return
    a, b = (np.concatenate(c) for c in zip(*parts, strict=True))
    nodes, places = np.unique(np.concatenate([a, b]), return_inverse=True)
    forest = Forest(len(nodes))
    for x, y in zip(places[: len(a)].tolist(), places[len(a) :].tolist(), strict=True):
        forest.join(x, y)
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[forest.roots()])], ["node", "root"])


def components(edges: DataFrame, few: int = FEW) -> DataFrame:
    """``node``, ``root`` for every node of the undirected edges ``a``, ``b`` (longs); the root is the least node.

    Self-loops and rows with a null are ignored. Edges are counted first: up to ``few`` go through one task. Of more, each
    round is written to the shared folder; rounds grow with the logarithm of the edges, and no round collects edges or
    nodes.
    """
    spark = edges.sparkSession
    now = written(spark, edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    if now.count() <= few:
        return now.coalesce(1).mapInArrow(lean(_joined), "node long, root long")
    seen = None
    while True:
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            break
        seen = state
        after = written(spark, _star(_star(now, True), False), "edges")
        forget(spark, now)
        now = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
