"""Wall seconds of named steps, as a table and, if asked, as lines of progress."""

from __future__ import annotations

import logging
import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

log = logging.getLogger("tessera")


class Timings:
    """Steps in order of their first start; a step that runs again adds up."""

    def __init__(self) -> None:
        self.seconds: dict[str, float] = {}

    @contextmanager
    def step(self, name: str) -> Iterator[None]:
        self.seconds.setdefault(name, 0.0)
        began = time.perf_counter()
        log.info("%s begins", name)
        try:
            yield
        finally:
            took = time.perf_counter() - began
            self.seconds[name] += took
            log.info("%s took %.3f s", name, took)

    def table(self, spark: SparkSession) -> DataFrame:
        """(step, seconds, percent): percent of all steps' seconds, 0 if there are none."""
        total = sum(self.seconds.values())
        rows = [(k, v, 100 * v / total if total else 0.0) for k, v in self.seconds.items()]
        return spark.createDataFrame(rows, "step string, seconds double, percent double")
