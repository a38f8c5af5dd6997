"""Joins whose key may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PARTS = 1000


def join_dealt(rows: DataFrame, other: DataFrame, key: str, spread: str, how: str = "inner", counts: DataFrame | None = None, also: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` joined with ``other`` on ``key`` (and the keys in ``also``, which play no part in dealing out).

    Keys that hold more than one in ``PARTS`` of the rows, so fewer than ``PARTS`` whatever the size, are
    counted first (``counts``: key, n; by partial counts, before any shuffle). Their rows are dealt out by a hash of
    ``spread`` into so many parts that none holds more than that, and meet a copy of the rows of ``other``
    in each part. No key is joined in one task, and nothing is broadcast.
    """
    if counts is None:
        counts = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = counts.where(F.col("n") * PARTS > total).select(key, "n").collect()
    if not hot:
        return rows.join(other, [key, *also], how)
    parts = max(r["n"] for r in hot) * PARTS // total + 1
    is_hot = F.coalesce(F.col(key).isin([r[key] for r in hot]), F.lit(False))
    dealt = rows.withColumn("_part", F.when(is_hot, F.pmod(F.xxhash64(spread), F.lit(parts)).cast("int")).otherwise(0))
    copies = other.withColumn("_part", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(parts - 1).cast("int"))).otherwise(F.array(F.lit(0)))))
    return dealt.join(copies, [key, *also, "_part"], how).drop("_part")
