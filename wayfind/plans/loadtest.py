"""How many searches at once: rounds of threads, more in each, until one takes too long."""

from __future__ import annotations

import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from urllib.parse import urlencode

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession


def request_url(base: str, **parameters: str | int) -> str:
    return f"{base}?{urlencode(parameters)}"


def load_test(spark: SparkSession, ask: Callable[[], object], start: int = 50, step: int = 10, most_seconds: float = 5.0, most_rounds: int = 20) -> DataFrame:
    """(threads, seconds, timed_out) by round; ``seconds`` is the round's wall time. The last round is the first with a time-out."""
    rows = []
    for number in range(most_rounds):
        threads = start + number * step

        def one() -> float:
            began = time.monotonic()
            ask()
            return time.monotonic() - began

        began = time.monotonic()
        with ThreadPoolExecutor(threads) as pool:
            took = [f.result() for f in [pool.submit(inheritable_thread_target(spark)(one)) for _ in range(threads)]]
        rows.append((threads, time.monotonic() - began, max(took) > most_seconds))
        if rows[-1][2]:
            break
    return spark.createDataFrame(rows, "threads int, seconds double, timed_out boolean")
