"""Sessions, and the package on executors that don't have it."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def session(cores: int | str = "*", name: str = "wayfind", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster, bring your own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(name)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.shuffle.partitions": "8",
    }
    for key, value in (settings | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> SparkSession:
    """Send the package to the executors, once for each context: Python workers need not have it installed."""
    context = spark.sparkContext
    if not getattr(context, "_wayfind_shipped", False):
        root = Path(__file__).resolve().parents[1]
        to = Path(tempfile.mkdtemp(prefix="wayfind-")) / "wayfind.zip"
        with zipfile.ZipFile(to, "w") as archive:
            for path in sorted(root.rglob("*")):
                if path.suffix in (".py", ".txt"):
                    archive.write(path, Path("wayfind") / path.relative_to(root))
        context.addPyFile(str(to))
        context._wayfind_shipped = True
    return spark
