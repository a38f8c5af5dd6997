"""Page ranks over a sparse edge list.

The rank starts at 1/N everywhere; then ``r <- 0.85 * A r + (1 - 0.85 / N)`` until no rank
changes by 0.001 or more. A link from a page to itself counts in its out-degree but gives
nothing, and the rank of pages without links is not handed on.

Graphs up to ``SMALL`` edges and as many nodes (both counted) run in one task over sparse numpy
arrays; larger ones in a loop of joins, whose state is written to the shared folder.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.tables import keep

DAMPING, TOLERANCE = 0.85, 0.001
SMALL = 5_000_000
SMALL_NODES = 3_000


def out_degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src").agg(F.count("*").alias("degree"))


def _nodes(edges: DataFrame, nodes: DataFrame | None) -> DataFrame:
    if nodes is not None:
        return nodes.select(F.col("page_id").alias("node")).distinct()
    return edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()


def iterate(src: np.ndarray, dst: np.ndarray, n: int, most: int = 1000) -> tuple[np.ndarray, int]:
    """Ranks of nodes 0..n-1 and the number of steps."""
    degree = np.bincount(src, minlength=n)
    pays = src != dst
    src, dst = src[pays], dst[pays]
    share = DAMPING / degree[src]
    rank, base = np.full(n, 1 / n), 1 - DAMPING / n
    for step in range(1, most + 1):
        new = np.bincount(dst, weights=share * rank[src], minlength=n) + base
        change = np.abs(new - rank).max()
        rank = new
        if change < TOLERANCE:
            break
    return rank, step


def solve(src: np.ndarray, dst: np.ndarray, n: int) -> np.ndarray:
    """The fixed point itself, by a dense linear system."""
    a = np.eye(n)
    degree = np.bincount(src, minlength=n)
    pays = src != dst
    np.add.at(a, (dst[pays], src[pays]), -DAMPING / degree[src[pays]])
    return np.linalg.solve(a, np.full(n, 1 - DAMPING / n))


def _whole(table: pa.Table, exact: bool) -> pa.Table:
    src, dst = table["src"].to_numpy(), table["dst"].to_numpy()
    node = dst[np.asarray(table["src"].is_null())].astype(np.int64) if table["src"].null_count else dst[:0]
    real = ~np.asarray(table["src"].is_null())
    src, dst = src[real].astype(np.int64), dst[real].astype(np.int64)
    node = np.unique(node)
    s, d = np.searchsorted(node, src), np.searchsorted(node, dst)
    rank = solve(s, d, len(node)) if exact else iterate(s, d, len(node))[0]
    return pa.table({"page_id": node, "page_rank": rank})


def _one_task(edges: DataFrame, nodes: DataFrame, exact: bool) -> DataFrame:
    rows = edges.select("src", "dst").union(nodes.select(F.lit(None).cast("long"), "node"))
    return rows.groupBy(F.lit(1).alias("all")).applyInArrow(lambda t: _whole(t.select(["src", "dst"]), exact), "page_id long, page_rank double")


def distributed(edges: DataFrame, nodes: DataFrame, most: int = 1000) -> DataFrame:
    """The loop of joins. Each step is one join by source, one sum by target and one join back to all nodes."""
    shares = keep(edges.where("src != dst").join(out_degrees(edges), "src").select("src", "dst", (F.lit(DAMPING) / F.col("degree")).alias("share")), "rank-shares")
    # dealt out by source once: each step shuffles ranks only; a lost part is read from the table again
    shares = shares.repartition("src").persist(StorageLevel.MEMORY_AND_DISK)
    nodes = keep(nodes, "rank-nodes")
    n = nodes.count()
    state = nodes.select("node", F.lit(1 / n if n else 0.0).alias("rank"), F.lit(1.0).alias("change"))
    for _ in range(most):
        given = shares.join(state.select(F.col("node").alias("src"), "rank"), "src").groupBy("dst").agg(F.sum(F.col("share") * F.col("rank")).alias("given"))
        new = F.coalesce("given", F.lit(0.0)) + (1 - DAMPING / n if n else 0.0)
        state = keep(state.join(given.withColumnRenamed("dst", "node"), "node", "left").select("node", new.alias("rank"), F.abs(new - F.col("rank")).alias("change")), "rank-state")
        if (state.agg(F.max("change")).first()[0] or 0.0) < TOLERANCE:
            break
    shares.unpersist()
    return state.select(F.col("node").alias("page_id"), F.col("rank").alias("page_rank"))


def page_rank(edges: DataFrame, nodes: DataFrame | None = None, small: int = SMALL) -> DataFrame:
    """(page_id, page_rank) of all nodes; ``nodes`` (page_id) adds pages without links."""
    edges = edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")).distinct()
    edges = keep(edges, "rank-edges")  # counted and read again
    known = _nodes(edges, nodes)
    if edges.count() <= small and (nodes is None or known.limit(small + 1).count() <= small):  # without `nodes` there are at most two for each edge
        return _one_task(edges, known, exact=False)
    return distributed(edges, known)


def page_rank_exact(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """The fixed point, for small graphs only: the system is dense."""
    edges = edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")).distinct()
    known = _nodes(edges, nodes)
    if (n := known.count()) > SMALL_NODES:
        raise ValueError(f"{n} nodes; a dense system is for at most {SMALL_NODES}")
    return _one_task(edges, known, exact=True)
