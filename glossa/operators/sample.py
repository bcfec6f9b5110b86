"""Samples, batches and splits: deterministic, and stable under repartitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glossa.session import cut


def hash_sample(df: DataFrame, key: Column, salt: str, n: int) -> DataFrame:
    """N rows in the order of SHA-256 of key and salt."""
    return df.orderBy(F.sha2(F.concat(key.cast("string"), F.lit(salt)), 256)).limit(n)


def stratified(df: DataFrame, stratum: list[str], order: list, quota: int | Column) -> DataFrame:
    """The first rows of each stratum, up to its quota."""
    return df.withColumn("__rn", F.row_number().over(W.partitionBy(*stratum).orderBy(*order))).where(F.col("__rn") <= quota).drop("__rn")


def numbered(df: DataFrame, order: list[str], name: str = "rn", buckets: int | None = None) -> DataFrame:
    """df with row numbers from 1 over a total order, without one task that sorts everything.

    Rows are range-partitioned, into as many parts as the session shuffles into if `buckets` is not given; the parts' sizes,
    summed before each, offset its own numbers. The sorted parts are written once, so sizes and rows are of the same order if an executor is lost.
    """
    parts = df.repartitionByRange(*([buckets] if buckets else []), *order).sortWithinPartitions(*order).withColumn("__p", F.spark_partition_id())
    parts = cut(parts.withColumn("__i", F.monotonically_increasing_id() - F.shiftleft(F.col("__p").cast("long"), 33)))
    sizes = parts.groupBy("__p").agg(F.count("*").alias("__n"))
    offset = sizes.select("__p", F.coalesce(F.sum("__n").over(W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__o"))
    return parts.join(F.broadcast(offset), "__p").withColumn(name, (F.col("__o") + F.col("__i") + 1).cast("long")).drop("__p", "__i", "__o")  # one row a part


def systematic(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """Every floor(size / n)-th row, n at most."""
    step = max(1, df.count() // n)
    return numbered(df, order).where(((F.col("rn") - 1) % step == 0) & (F.col("rn") <= step * n))


def round_robin(df: DataFrame, group: str, order: list[str]) -> DataFrame:
    """`turn` and `group` order: the first of each group, then the second of each, and so on."""
    return df.withColumn("turn", F.row_number().over(W.partitionBy(group).orderBy(*order)))


def batches(df: DataFrame, order: list[str], size: int) -> DataFrame:
    """Rows in batches of a fixed size."""
    return numbered(df, order).withColumn("batch", F.floor((F.col("rn") - 1) / size)).drop("rn")


def split_at(df: DataFrame, order: list[str], share: float) -> DataFrame:
    """`side` 0 for the first share of the rows, 1 for the rest."""
    first = int(df.count() * share)
    return numbered(df, order).withColumn("side", (F.col("rn") > first).cast("int"))
