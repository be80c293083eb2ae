"""The driver's tables as the relations that operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, vec, label) of embeddings."""
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"), "label")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, sample, vec): the first two dimensions as coordinates, odd and even ids as samples."""
    return features(spark, sf_dir).select("id", (F.col("id") % 2).cast("int").alias("sample"), F.slice("vec", 1, 2).alias("vec"))


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, vec): five numbers of each supplier's lines."""
    li = read(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("id"))
    agg = li.agg(F.sum("l_quantity").alias("a"), F.avg("l_extendedprice").alias("b"), F.avg("l_discount").alias("c"), F.avg("l_tax").alias("d"), F.count("*").alias("e"))
    return agg.select("id", F.array(*(F.round(F.col(c).cast("double"), 3) for c in "abcde")).alias("vec"))


def digest(*parts) -> F.Column:
    """A number below 65,536 from the md5 of the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *(p.cast("string") for p in parts))), 1, 4), 16, 10).cast("int")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, truth, pred): labels, and the same with a quarter of the rows moved to the next class."""
    moved = F.when(digest(F.lit("p"), F.col("id")) % 4 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return features(spark, sf_dir).select("id", F.col("label").alias("truth"), moved.alias("pred"))


def run_labels(spark: SparkSession, sf_dir: str, runs: int = 8) -> DataFrame:
    """(run, id, label): labels with a fifth of each run's rows changed; 0 is missing."""
    f = features(spark, sf_dir).select("id", "label", F.explode(F.sequence(F.lit(1), F.lit(runs))).alias("run"))
    moved = F.when(digest(F.col("run"), F.col("id")) % 5 == 0, (F.col("label") + F.col("run")) % 10).otherwise(F.col("label"))
    return f.select("run", "id", moved.alias("label"))


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run, cycle, accuracy, score, ...): running maxima by customer and what follows from their keys, as an optimiser's trace."""
    from pyspark.sql.window import Window

    c = read(spark, sf_dir, "customer").where("c_custkey is not null").select((F.col("c_nationkey") + 1).alias("run"), F.col("c_custkey").alias("key"), "c_acctbal")
    w = Window.partitionBy("run").orderBy("key")
    acc = F.round((F.col("c_acctbal") + 1000) / 12000, 9)
    t = c.withColumn("cycle", F.row_number().over(w)).withColumn("accuracy", F.max(acc).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    up, warm = F.col("key") % 3 == 0, (F.col("key") % 7 == 0) & (F.col("key") % 3 > 0)
    return t.select(
        "run", "cycle", "accuracy", F.col("accuracy").alias("score"), (F.col("key") * 7 % 23 + 1).cast("int").alias("proposal_size"), (F.col("key") % 5 + 2).cast("int").alias("active_classes"),
        (up | warm).alias("accepted"), up.alias("improving"), warm.alias("temperature"),
    )
