"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Sources in code point order (null last) weigh 5, 2, 1, 5, 2, 1, ... and share ``SHARE`` times
the words of all documents; a target stops at ``MOST`` times its source's words and the
excess is shared again by weight. A source is taken in complete epochs first. The rest of
its target is filled by its documents in the order of their exponential keys
``-ln(u) / quality``, the last one in part.

No source is sorted as a whole: keys fall into bins of about ``BIN_ROWS`` documents (their number is
drawn from the count of all, and is ``LEAST_BINS`` at least), whose words are added up before the
shuffle; prefix sums over the bins find the one bin of each source in which its budget ends,
and only that bin's documents are ordered. Only ids, sizes and keys are shuffled, never texts.
What is ordered in one task is the sources (names and sums, one row each) and each source's bins.

The quality weight is a column of the caller's; ``scored`` makes one of a quality classifier's scores. The default
needs no model: the share of characters that are no digits or marks.

Defined results: a null text has no words and is taken with 0. Repeated rows, and different texts under one
doc_id (or none), are documents of their own with equal ``u``; ties of keys go by doc_id (null first) and size. ``u``
is a hash of ``doc_id``, so reruns agree. Very long texts are rows like others; one may be taken in part. Other
columns are ignored, whatever their names. No documents: no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import storage

SHARE, MOST = 1.5, 2.0
WEIGHTS = (5, 2, 1)
LEAST_BINS, BIN_ROWS = 1 << 12, 1 << 12
WORD = r"[^\x20\x09-\x0D]+"
MARKS = "0123456789!#$%&*|=+<>@^_~"


def clean_share(text: str = "text") -> Column:
    """A quality weight in (0.05, 1]: the share of characters that are no digits or marks."""
    return F.coalesce(0.05 + 0.95 * F.length(F.translate(F.col(text), MARKS, "")) / F.when(F.length(text) > 0, F.length(text)), F.lit(1.0))


def scored(docs: DataFrame, scores: DataFrame, doc_id: str = "doc_id", least: float = 0.05) -> DataFrame:
    """``docs`` with ``_weight``: ``least`` to 1 in proportion to a score between 0 and 1 (``scores``: doc_id, score).

    Of several scores of a doc_id the highest counts; documents without one weigh ``least``.
    """
    best = scores.groupBy(F.col("doc_id").alias(doc_id)).agg(F.max("score").alias("_score"))
    return docs.join(best, doc_id, "left").withColumn("_weight", least + (1 - least) * F.least(F.greatest(F.coalesce("_score", F.lit(0.0)), F.lit(0.0)), F.lit(1.0))).drop("_score")


def uniform(doc_id: str = "doc_id") -> Column:
    """In (0, 1), from the first 52 bits of a digest."""
    digest = F.md5(F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit("|mix")))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") + 0.5) / float(1 << 52)


def targets(sources: DataFrame, share: float = SHARE, most: float = MOST, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """``sources`` (none, source, source_size), one row for each source, with ``target``.

    Filling up to caps in the order of cap by weight: a source is capped if its cap is
    below what the sources from it on would get for its weight. Windows without a
    partition are over sources, not documents.
    """
    row = F.pmod(F.row_number().over(Window.orderBy("none", "source")) - 1, F.lit(len(weights)))
    weighed = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), row + 1)).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "none", "source")
    whole = Window.partitionBy()
    filled = weighed.withColumn("rank", F.row_number().over(order))
    filled = filled.withColumn("all_words", F.sum("source_size").over(whole) * F.lit(float(share)))
    filled = filled.withColumn("left_words", F.col("all_words") - F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) + F.col("cap"))
    filled = filled.withColumn("level", F.col("left_words") / F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    free = F.when(F.col("cap") / F.col("weight") >= F.col("level"), F.col("rank"))
    filled = filled.withColumn("first", F.min(free).over(whole))
    level = F.max(F.when(F.col("rank") == F.col("first"), F.col("level"))).over(whole)
    # no document may come more than `most` times, whatever the last bit of a division says
    return filled.withColumn("target", F.when(F.col("rank") < F.coalesce("first", F.lit(1 << 30)), F.col("cap")).otherwise(F.least(level * F.col("weight"), F.col("cap")))).select("none", "source", "source_size", "target")


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weight: Column | None = None) -> DataFrame:
    """doc_id, size, source_size, target, taken and epochs of each document; see the module."""
    quality = clean_share(text) if weight is None else weight
    base = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.col(source).isNull().alias("none"),
        F.coalesce(F.col(source), F.lit("")).alias("source"),
        F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        (-F.log(uniform(doc_id)) / quality).alias("key"),
    )
    base = storage.keep(base, "mix-keys")
    n_bins = max(LEAST_BINS, 1 << (base.count() // BIN_ROWS).bit_length())
    base = base.withColumn("bin", F.least(F.floor((1 - F.exp(-F.col("key"))) * n_bins), F.lit(n_bins - 1)).cast("int"))
    bins = storage.keep(base.groupBy("none", "source", "bin").agg(F.sum("size").alias("words")), "mix-bins")
    aimed = targets(bins.groupBy("none", "source").agg(F.sum("words").alias("source_size")))
    aimed = aimed.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
    aimed = aimed.withColumn("rest", F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long"))
    upto = Window.partitionBy("none", "source").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = bins.withColumn("before", F.sum("words").over(upto) - F.col("words")).join(aimed.select("none", "source", "rest"), ["none", "source"])
    ends = ends.where("before < rest and before + words >= rest").select("none", "source", F.col("bin").alias("end_bin"), "before")
    plan = storage.keep(aimed.join(ends, ["none", "source"], "left"), "mix-plan")  # its size decides how it is joined
    placed = base.join(plan, ["none", "source"])
    part = F.when(F.col("rest") <= 0, 0).when(F.col("end_bin").isNull() | (F.col("bin") < F.col("end_bin")), F.col("size")).otherwise(0)
    easy = placed.where("end_bin is null or bin != end_bin").withColumn("part", part.cast("long"))
    order = Window.partitionBy("none", "source").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    room = F.col("rest") - F.col("before") - (F.sum("size").over(order) - F.col("size"))
    last = placed.where("bin = end_bin").withColumn("part", F.greatest(F.lit(0), F.least(F.col("size"), room)).cast("long"))
    out = easy.unionByName(last)
    return out.select("doc_id", "size", "source_size", "target", (F.col("epochs") * F.col("size") + F.col("part")).cast("long").alias("taken"), F.col("epochs").cast("int").alias("epochs"))
