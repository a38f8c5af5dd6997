"""Connected components of an edge table, by alternating stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import storage


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Within a task: union-find, so that each node goes on with one edge to its least node."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while parent.setdefault(top, top) != top:
            top = parent[top]
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    def flush() -> pa.RecordBatch:
        found = [(x, r) for x in parent if (r := root(x)) != x]
        return pa.RecordBatch.from_arrays([pa.array([p[i] for p in found], pa.int64()) for i in (0, 1)], ["a", "b"])

    for batch in batches:
        for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x, y = root(x), root(y)
            if x != y:
                parent[max(x, y)] = min(x, y)
        if len(parent) > 500_000:
            yield flush()
            parent.clear()
    yield flush()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) of all nodes of ``edges`` (a, b): the least node that each reaches.

    Each round, every node links its larger neighbours, then its smaller ones, to the
    least of its neighbourhood; the rounds needed grow with the logarithm of the size.
    A hub's rows are only counted and joined by key, never gathered.
    """
    edges = edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = storage.keep(edges.mapInArrow(_contract, "a long, b long").distinct(), "edges")
    state = lambda e: tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.countDistinct("a")).first())
    before = state(edges)
    for _ in range(most_rounds):
        if before[0] == 0 or before[0] == before[2] and not edges.join(edges.select(F.col("a").alias("b")), "b", "left_semi").take(1):
            break  # each node has one edge, and to a node without any
        both = edges.union(edges.select("b", "a")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u and v != m").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        edges = storage.keep(small.union(down.select("a", F.col("m").alias("b"))).distinct(), "edges")
        before = state(edges)
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
