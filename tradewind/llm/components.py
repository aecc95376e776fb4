"""Connected components of an edge table, by alternating stars: no vertex's neighbours meet in one task's memory,
and each round is written to the shared folder, so a lost executor costs a round at most."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, small_batches, written

ROUNDS = 60
#: Edges that a task brings to stars at once before the first round.
EDGES = 1 << 20


class Groups:
    """Disjoint sets of numbers, each known by its smallest."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, v: int) -> int:
        up = self.up
        while (to := up.get(v, v)) != v:
            up[v] = v = up.get(to, to)
        return v

    def join(self, a: int, b: int) -> bool:
        """False if they were one set already."""
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b


def stars(edges: DataFrame) -> DataFrame:
    """a, b: the edges of each task's part as stars around their smallest nodes, a > b."""
    small_batches(edges.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, n = Groups(), 0

        def flush() -> pa.RecordBatch:
            nodes = list(groups.up)
            return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(map(groups.find, nodes), pa.int64())], ["a", "b"])

        for batch in batches:
            a, b = (batch[c].to_numpy() for c in ("a", "b"))
            new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])] if len(a) else np.empty(0, bool)
            for one, two in zip(a[new].tolist(), b[new].tolist(), strict=True):
                groups.join(one, two)
            n += len(a)
            if n >= EDGES:
                yield flush()
                groups, n = Groups(), 0
        yield flush()

    return edges.select("a", "b").mapInArrow(run, "a long, b long")


def _settled(edges: DataFrame) -> bool:
    """Whether all edges are stars: each node hangs on one other, which hangs on none."""
    ends = edges.select("a", F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("b", F.lit(0), F.lit(1)))
    nodes = ends.groupBy("a").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return nodes.filter("up > 1 or up = 1 and down = 1").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node of each component, for every node that has an edge to another. edges: a, b long."""
    edges = written(stars(edges).distinct(), "edges")
    for _ in range(ROUNDS):
        if _settled(edges):
            break
        # Large star: hang every larger neighbour of a node on the node's smallest neighbour.
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # Small star: hang a node and its smaller neighbours on the smallest of them.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        lower = large.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        before, edges = edges, written(lower.union(least.select("a", F.col("m").alias("b"))).distinct(), "edges")
        dropped(before)
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select("b", "b").distinct())
