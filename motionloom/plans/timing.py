"""Seconds spent in each step of a run, as rows."""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession

T = TypeVar("T")
STEPS = ("read", "detect", "egomotion", "stabilize", "track", "record")


class Stopwatch:
    """Times calls; the n-th call of a step is its frame n."""

    def __init__(self, clock: Callable[[], float] = time.perf_counter):
        self.clock, self.calls, self.rows = clock, Counter(), []

    def time(self, step: str, call: Callable[[], T]) -> T:
        began = self.clock()
        result = call()
        self.rows.append((step, self.calls[step], self.clock() - began))
        self.calls[step] += 1
        return result

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, "step string, frame long, seconds double")
