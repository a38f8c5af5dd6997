"""A corpus pipeline: toxicity, near-duplicates, decontamination, personal data, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result
as Parquet to the shared folder and rereads it as the next stage's documents. All stages
but the last return the columns of ``documents`` and no others; the last returns, for each document
that is left, how many words of it the mix takes (``doc_id, size, source_size, target, taken, epochs``):
its texts are those of the stage before.

Defined results, of all stages: an empty table gives an empty one. Null or empty texts pass every filter (they hold
nothing that is looked for) and have no words in the mix. Any column may be null, a doc_id too. Very long texts
are worked on whole. Other columns, whatever their names, are left out. How rows that repeat a doc_id or a text
fare is said by each stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfind.llm import storage
from wayfind.llm.op3_minhash import linked, numbered
from wayfind.llm.op5_pii import redact
from wayfind.llm.op8_mixing import mix
from wayfind.llm.op9_toxicity import clean
from wayfind.llm.op10_decontaminate import without_items

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go: those that score ``op9_toxicity.THRESHOLD`` or more.

    Rows are judged by their text alone, so repeated rows and equal texts go or stay together.
    """
    return clean(docs, storage.table(spark, sf_dir, "labels")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by five-word shingles at 0.8 or more, one row stays: of the smallest doc_id, a null one being the smallest.

    Of several rows with that doc_id, the one whose columns have the least ``xxhash64``, then the first. Repeated
    rows are a group. Different texts under one doc_id, or none, are not linked by it. Of texts without words,
    which are linked with nothing, equal ones under one doc_id are one.
    """
    # a doc_id may be null or shared by different texts, so groups are of numbered rows
    rows = numbered(docs.select(*COLUMNS))
    order = F.struct(F.coalesce(F.col("doc_id"), F.lit(-(1 << 63))).alias("id"), F.xxhash64(*COLUMNS).alias("digest"), "row").alias("order")
    # texts without words are linked with nothing: repeated ones of a doc_id are one
    blank = F.when(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.col("text")).alias("blank")
    facts = rows.select("row", "doc_id", blank, order).join(linked(rows, shingle=5, percent=80), "row")
    group = F.when(F.col("n_shingles") > 0, F.col("component")), F.when(F.col("n_shingles") == 0, F.struct("doc_id", "blank"))
    kept = facts.groupBy(*(g.alias(f"group_{i}") for i, g in enumerate(group))).agg(F.min("order").alias("order")).select("order.row")
    return rows.join(kept, "row", "left_semi").select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, up to a few edits, go; each row by its own text, so repeated ones go together."""
    return without_items(docs, storage.table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data are replaced by their kind, row by row; ``n_chars`` is counted anew where there is a text."""
    return redact(docs).withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text")).otherwise(F.col("n_chars")).cast("long")).select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How often and how far each document is taken; repeated rows are documents of their own, with ties in the order of doc_id and size."""
    return mix(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("mixing", mixing),
]

ORACLE_SQL = None  # a trained classifier is not expressible


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = storage.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = storage.keep(stage(spark, docs, sf_dir), f"pipeline-{name}", storage.TEXT_ROWS)
    return docs
