"""Versions of a table that are compared by a tree of digests: only what differs is read.

A version is a folder: `schema`, `rows`, partitioned by the bucket of their key's hash, and `tree`, the digests of the
buckets and of the nodes above them up to one root. Two versions with the same number of buckets put equal keys into equal
buckets, so the walk from both roots down to the buckets that differ tells which rows can differ at all.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glossa.operators.joins import row_diff

FANOUT = 16
MOST_BUCKETS = 1 << 16  # bucket numbers that a reader holds as a list


def _bucket(keys: list[str], buckets: int) -> Column:
    # a hash of the keys' JSON, so a key of another integer type has the same bucket
    return F.pmod(F.xxhash64(F.to_json(F.struct(*keys), {"ignoreNullFields": "false"})), F.lit(buckets)).cast("int")


def _levels(buckets: int) -> int:
    levels = 0
    while FANOUT**levels < buckets:
        levels += 1
    if FANOUT**levels != buckets or buckets > MOST_BUCKETS:
        raise ValueError(f"the number of buckets must be a power of {FANOUT}, {MOST_BUCKETS} at most")
    return levels


def buckets_for(rows: int) -> int:
    """A number of buckets of about 100,000 rows each, within the bounds."""
    buckets = FANOUT
    while buckets < MOST_BUCKETS and rows > 100_000 * buckets:
        buckets *= FANOUT
    return buckets


def write(df: DataFrame, root: str, keys: list[str], buckets: int = 256) -> str:
    """Writes df as a version at root and returns the root's digest.

    A bucket's digest is the number of its rows and four sums of 60 bits of their SHA-256, so it depends neither on the
    order of rows or columns nor on files, and adds up partially; a node's is the SHA-256 of its children's in order. An empty
    bucket has none. Rows of equal keys are told apart as long as they differ.
    """
    levels = _levels(buckets)
    spark = df.sparkSession
    rows = df.withColumn("__bucket", _bucket(keys, buckets))
    spark.createDataFrame([(rows.schema.json(),)], "value string").write.text(f"{root}/schema")
    rows.repartition("__bucket").write.partitionBy("__bucket").parquet(f"{root}/rows")
    back = spark.read.schema(rows.schema).parquet(f"{root}/rows")  # what is digested is what was written
    sha = F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)
    sums = [F.sum(F.conv(F.substring(sha, 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)")).cast("string") for k in range(4)]
    leaf = F.sha2(F.concat_ws("-", F.count("*").cast("string"), *sums), 256)
    level = back.groupBy("__bucket").agg(leaf.alias("digest"), F.count("*").alias("n")).select(F.lit(levels).alias("level"), F.col("__bucket").alias("node"), "digest", "n")
    level.write.partitionBy("level").parquet(f"{root}/tree")
    for up in range(levels - 1, -1, -1):
        below = _level(spark, root, up + 1)
        told = F.array_sort(F.collect_list(F.struct("node", "digest")))  # FANOUT at most
        node = F.sha2(F.array_join(F.transform(told, lambda c: F.concat_ws(":", c["node"].cast("string"), c["digest"])), ","), 256)
        above = below.groupBy(F.floor(F.col("node") / FANOUT).cast("int").alias("node")).agg(node.alias("digest"), F.sum("n").alias("n"))
        above.select(F.lit(up).alias("level"), "node", "digest", "n").write.mode("append").partitionBy("level").parquet(f"{root}/tree")
    return digest(spark, root)


def _level(spark: SparkSession, root: str, level: int) -> DataFrame:
    return spark.read.schema("node int, digest string, n long, level int").parquet(f"{root}/tree").where(F.col("level") == level).drop("level")


def digest(spark: SparkSession, root: str) -> str:
    """The digest of all rows of a version; the empty string for an empty one."""
    top = _level(spark, root, 0).first()
    return top["digest"] if top else ""


def unequal(spark: SparkSession, old: str, new: str, buckets: int = 256) -> list[int]:
    """The buckets that differ, found from the roots down; a level reads the children of nodes that differ alone."""
    differ = [0]
    for level in range(_levels(buckets) + 1):
        of = F.col("node") if level == 0 else F.floor(F.col("node") / FANOUT).cast("int")
        a, b = (_level(spark, r, level).where(of.isin(differ)).select("node", F.col("digest").alias(c)) for r, c in ((old, "a"), (new, "b")))
        differ = sorted(r["node"] for r in a.join(b, "node", "full_outer").where(~F.col("a").eqNullSafe(F.col("b"))).select("node").collect())  # MOST_BUCKETS at most
        if not differ:
            return []
    return differ


def part(spark: SparkSession, root: str, buckets: list[int]) -> DataFrame:
    """The rows of some buckets; the files of others are not opened."""
    schema = T.StructType.fromJson(json.loads(spark.read.text(f"{root}/schema").first()["value"]))
    rows = spark.read.schema(schema).parquet(f"{root}/rows")
    return rows.where(F.col("__bucket").isin(buckets) if buckets else F.lit(False)).drop("__bucket")


def diff(spark: SparkSession, old: str, new: str, keys: list[str], buckets: int = 256) -> DataFrame:
    """The keys that were added, removed or changed between two versions, as `row_diff` tells them.

    Both were written with these keys and this number of buckets. A column that only one side has makes every row differ.
    """
    touched = unequal(spark, old, new, buckets)
    return row_diff(part(spark, old, touched), part(spark, new, touched), keys)
