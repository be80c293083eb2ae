"""Table helpers whose cost doesn't meet in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.session import bounded, partitions, written


#: Rows of a table that is broadcast beside others, if it isn't one row by its plan.
FEW = 65_536


def beside(rows: DataFrame, few: DataFrame) -> DataFrame:
    """Each row beside each row of a table that has one row, or one a class or column: a broadcast join on a constant key.

    A table that isn't one row by its plan is written, and its rows are counted first: more than FEW raise TooLarge.
    """
    most = few._jdf.queryExecution().optimizedPlan().maxRows()
    if not most.isDefined() or most.get() > 1:
        few = written(few, "few")
        bounded(few, FEW, "rows of a table to broadcast")
    return rows.withColumn("_one", F.lit(1)).join(F.broadcast(few.withColumn("_one", F.lit(1))), "_one").drop("_one")


def ranked(rows: DataFrame, keys: list[str], shuffle: Column, *ties: str, name: str = "r") -> DataFrame:
    """Adds the rank (from 1) by a hexadecimal shuffle key, then ties, within keys. A group is ranked in 256
    ranges of its key, whose sizes give the ranges' starts, so that a crowded group is many tasks."""
    keyed = rows.withColumn("_k", shuffle).withColumn("_range", F.substring("_k", 1, 2))
    group = [*keys, "_range"]
    sizes = keyed.groupBy(*group).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))  # 256 rows a group
    starts = sizes.select(*group, F.coalesce(before, F.lit(0)).alias("_start"))
    within = F.row_number().over(Window.partitionBy(*group).orderBy("_k", *ties))
    out = keyed.withColumn(name, within).join(starts, group)
    return out.withColumn(name, F.col(name) + F.col("_start")).drop("_k", "_range", "_start")


def numbered(rows: DataFrame, *order: str, name: str = "number") -> DataFrame:
    """Adds 1, 2, 3, ... by the order columns (unique together): ranges are sorted apart, and their sizes added up."""
    ranges = rows.repartitionByRange(partitions(rows.sparkSession), *order).withColumn("_part", F.spark_partition_id())
    ranges = written(ranges, "ranges")
    sizes = ranges.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))  # one row a partition
    starts = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_start"))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    out = ranges.withColumn(name, within).join(F.broadcast(starts), "_part")
    return out.withColumn(name, F.col(name) + F.col("_start")).drop("_part", "_start")


#: Accuracy of the quantile sketch that brackets a median.
SKETCH = 10_000


def medians(long: DataFrame) -> DataFrame:
    """long(c, v) -> (c, v): each column's exact median (the middle two averaged).

    A sketch brackets the middle ranks; what lies below is counted, and only the values inside the bracket,
    a few in a thousand, are sorted.
    """
    eps = 3.0 / SKETCH
    q = long.groupBy("c").agg(F.count("v").alias("n"), F.percentile_approx("v", F.array(F.lit(0.5 - eps), F.lit(0.5 + eps)), F.lit(SKETCH)).alias("q"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    small = F.col("n") < SKETCH
    q = q.select("c", "n", F.when(small, F.col("lo")).otherwise(F.get("q", 0)).alias("lo"), F.when(small, F.col("hi")).otherwise(F.get("q", 1)).alias("hi"))
    q = written(q, "brackets")
    met = long.join(F.broadcast(q), "c")  # one row a column
    below = met.groupBy("c").agg(F.count(F.when(F.col("v") < F.col("lo"), 1)).alias("below"))
    inside = met.where("v between lo and hi").groupBy("c", "n", "v").agg(F.count("*").alias("k")).join(F.broadcast(below), "c")
    upto = F.sum("k").over(Window.partitionBy("c").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)) + F.col("below")
    ends = inside.withColumn("last", upto).withColumn("first", F.col("last") - F.col("k") + 1)
    low, high = F.floor((F.col("n") + 1) / 2), F.floor((F.col("n") + 2) / 2)
    at = lambda r: F.max(F.when((F.col("first") <= r) & (r <= F.col("last")), F.col("v")))
    return ends.groupBy("c").agg(((at(low) + at(high)) / 2).alias("v"))
