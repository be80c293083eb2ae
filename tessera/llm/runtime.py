"""Small helpers that tie the operators of this subpackage to a Spark session."""

from __future__ import annotations

import os
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..session import discard, partitions, shared_dir, written  # noqa: F401

#: Rows in an Arrow batch that goes to Python; texts average a few KB and the longest are far longer.
BATCH_ROWS = 1024


def prepare(spark: SparkSession) -> None:
    """Lets Python workers import this package and keeps their Arrow batches small."""
    env, here = spark.sparkContext.environment, str(Path(__file__).resolve().parents[2])
    if here not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (here, env.get("PYTHONPATH", "")) if x)
    env.setdefault("ARROW_DEFAULT_MEMORY_POOL", "system")  # gives freed memory back
    env.setdefault("MALLOC_TRIM_THRESHOLD_", "262144")
    # a union that claims its children's partitioning can have twice their partitions once adaptive execution has merged some
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def sliced(batch: pa.RecordBatch, rows: int = 16_384) -> Iterator[pa.RecordBatch]:
    """The batch in pieces: what Python returns is held off-heap by the JVM until it is read."""
    for a in range(0, batch.num_rows, rows):
        yield batch.slice(a, rows)


def fresh(name: str, columns: list[str]) -> str:
    """The name, or with underscores after it, that none of the columns has."""
    held = {c.lower() for c in columns}
    while name.lower() in held:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
