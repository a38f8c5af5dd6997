"""Tables that cut lineage, in the folder that all executors share.

Results are lazy and read these tables, so they stay until ``clear`` removes those of a ``mark``,
once the results are written: ``at = mark(); use(result); clear(spark, at)``.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


_KEPT: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; one of our own only where it is unset and all runs on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="wayfind-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    _KEPT.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return _KEPT[-1]


def mark() -> int:
    """A point to which ``clear`` goes back."""
    return len(_KEPT)


def clear(spark: SparkSession, since: int = 0) -> int:
    """Remove the tables kept since a mark; how many there were. What reads them must be done."""
    gone = _KEPT[since:]
    del _KEPT[since:]
    for path in gone:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        spark.sql(f"DROP TABLE IF EXISTS {path.rsplit('/', 1)[1].replace('-', '_')}")
    return len(gone)


TEXT_ROWS = 1000  # rows of an Arrow batch that holds whole texts


@contextmanager
def batches(spark: SparkSession, rows: int | None) -> Iterator[None]:
    """Bounds the Arrow batches of the jobs inside."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    if rows:
        spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def keep(df: DataFrame, name: str, rows_a_batch: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: later jobs start from there.

    ``rows_a_batch`` bounds the Arrow batches of this job, for rows that hold whole texts.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    with batches(spark, rows_a_batch):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def keep_bucketed(df: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """The same, bucketed by ``keys`` as the shuffle by them deals rows out: later joins on them don't move it again."""
    spark = df.sparkSession
    path = new_path(spark, name)
    table_name = path.rsplit("/", 1)[1].replace("-", "_")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.option("compression", "zstd").option("path", path).bucketBy(buckets, *keys).format("parquet").saveAsTable(table_name)
    return spark.table(table_name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
