"""Session helpers: worker imports, shared tables, sizes."""

from __future__ import annotations

import os
import re
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def prepare(spark: SparkSession) -> None:
    """Lets Python workers import this package, and settles the session for its plans."""
    env, here = spark.sparkContext.environment, str(Path(__file__).resolve().parents[1])
    if here not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (here, env.get("PYTHONPATH", "")) if x)
    # a union that claims its children's partitioning can have twice their partitions once adaptive execution has merged some
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, in spark.checkpoint.dir; only a local master, as in tests, may leave it unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir isn't set: it names a folder that the driver and all executors share")
        root = "file:///tmp/checkpoints"
    return f"{root.rstrip('/')}/tessera-{spark.sparkContext.applicationId}"


#: Rows of a file of a table whose number of rows is known to be small.
FILE_ROWS = 100_000


def written(df: DataFrame, name: str = "table", rows: int | None = None) -> DataFrame:
    """df as a table in the shared folder, read back: computed once, lineage cut, safe against lost executors.

    rows: what df has at most, if that is known; then small tables are few files.
    """
    prepare(df.sparkSession)
    if rows is not None:
        df = df.coalesce(max(1, min(partitions(df.sparkSession), -(-rows // FILE_ROWS))))
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def discard(*tables: DataFrame | None) -> None:
    """Removes tables that written() made and that nothing reads any more; others are left."""
    for df in tables:
        if path := getattr(df, "_written", None):
            _delete(df.sparkSession, path)


def clear(spark: SparkSession) -> None:
    """Removes all intermediate tables of this application; results that weren't read yet are lost."""
    _delete(spark, shared_dir(spark))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


class TooLarge(ValueError):
    """Raised before a kernel that needs its whole input in one task gets more than it was made for."""


def bounded(df: DataFrame, most: int, what: str) -> int:
    """The number of rows, if at most that many; it is checked before the rows meet in one task."""
    n = df.limit(most + 1).count()
    if n > most:
        raise TooLarge(f"{what}: more than {most} rows for one task")
    return n
