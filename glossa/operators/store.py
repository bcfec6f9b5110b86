"""Versioned stores: build, merge, delta and promotion, without a table format.

A store is a DataFrame with a unique key; a version is a folder that is written once, and a
pointer file is what readers follow. Writers stage, verify, then flip the pointer.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.operators.joins import keep_first, row_diff
from glossa.operators.sample import batches


def build(existing: DataFrame, candidates: DataFrame, corpus: DataFrame, keys: list[str], issues) -> DataFrame:
    """Rows of both with their fate: stale (key not in the corpus), rejected (issues), or accepted (the first of a key)."""
    rows = existing.withColumn("prio", F.lit(0)).unionByName(candidates.withColumn("prio", F.lit(1)))
    rows = rows.join(corpus.select(*keys).distinct().withColumn("__live", F.lit(True)), keys, "left")
    fate = F.when(F.col("__live").isNull(), "stale").when(F.size(issues) > 0, "rejected").otherwise("accepted")
    rows = rows.withColumn("fate", fate).drop("__live")
    kept = keep_first(rows.where("fate = 'accepted'"), keys, ["prio"])
    return kept.unionByName(rows.where("fate <> 'accepted'"))


def protected_upsert(store: DataFrame, incoming: DataFrame, keys: list[str], verified: str, fields: list[str]) -> DataFrame:
    """Incoming rows are inserted if new and update only if they are verified; a verified row that would
    change, or a key twice in the batch, rejects the whole batch."""
    if incoming.groupBy(*keys).count().where("count > 1").limit(1).count():
        raise ValueError("the batch holds a key twice")
    right = incoming.select(*keys, F.col(verified).alias("__ok"), *[F.col(c).alias(f"__{c}") for c in fields])
    both = store.withColumn("__old", F.lit(True)).join(right.withColumn("__new", F.lit(True)), keys, "full_outer")
    differs = F.lit(False)
    for c in fields:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"__{c}"))
    if both.where(F.col("__old") & F.col("__new") & F.col(verified) & differs).limit(1).count():
        raise ValueError("the batch would change a verified row")
    take = F.col("__old").isNull() | (F.coalesce("__new", F.lit(False)) & F.col("__ok"))
    return both.select(*keys, F.when(take, F.col("__ok")).otherwise(F.col(verified)).alias(verified), *[F.when(take, F.col(f"__{c}")).otherwise(F.col(c)).alias(c) for c in fields])


def insert_only(store: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """The store and the rows of keys it does not have; applying it again changes nothing."""
    return store.unionByName(incoming.join(store, keys, "left_anti"))


def enrich(store: DataFrame, extra: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """The store with missing fields filled; what it has is never changed."""
    right = extra.select(*keys, *[F.col(c).alias(f"__{c}") for c in fields])
    joined = store.join(right, keys, "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.col(f"__{c}")) for c in fields}).select(*store.columns)


def partition_candidates(store: DataFrame, candidates: DataFrame, keys: list[str], field: str, issues) -> DataFrame:
    """Candidates labelled new, additional (the key has another value), same or quarantine."""
    right = store.select(*keys, F.col(field).alias("__have"), F.lit(True).alias("__known"))
    label = F.when(F.size(issues) > 0, "quarantine").when(F.col("__known").isNull(), "new").when(F.col("__have").eqNullSafe(F.col(field)), "same").otherwise("additional")
    return candidates.join(right, keys, "left").withColumn("label", label).drop("__have", "__known")


def version(df: DataFrame) -> str:
    """A content hash that does not depend on the order of rows or columns; one row reaches the driver."""
    text = F.to_json(F.struct(*sorted(df.columns)))
    r = df.agg(F.count("*").alias("n"), *[F.sum(F.conv(F.substring(F.sha2(text, 256), 1 + 8 * k, 8), 16, 10).cast("decimal(38,0)")).alias(f"s{k}") for k in range(3)]).first()
    return "-".join(str(x or 0) for x in r)


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p, jvm


def publish(df: DataFrame, root: str, keys: list[str]) -> str:
    """Writes df as a version of the store at root and flips its pointer; returns the version.

    Nothing is written if that version is current. The version is written under a name of this
    writer's own, read back and compared, then renamed; the pointer, which also names the version
    before, is replaced last and in one step, so readers see the old or the new store whole,
    whatever fails, and `rollback` finds the way back.
    """
    spark = df.sparkSession
    name, before = version(df), current(spark, root)
    fs, target, jvm = _fs(spark, f"{root}/{name}")
    if before == name:
        return name
    if not fs.exists(target):
        staged = f"{root}/_staged-{uuid.uuid4().hex}"
        df.write.parquet(staged)
        back = spark.read.schema(df.schema).parquet(staged)
        if version(back) != name or back.groupBy(*keys).count().where("count > 1").limit(1).count():
            fs.delete(jvm.org.apache.hadoop.fs.Path(staged), True)
            raise ValueError("the staged version does not hold what was to be written, or a key is not unique")
        if fs.exists(target) or not fs.rename(jvm.org.apache.hadoop.fs.Path(staged), target):  # another writer was faster with the same version
            fs.delete(jvm.org.apache.hadoop.fs.Path(staged), True)
    _point(spark, root, name, before)
    return name


def rollback(spark: SparkSession, root: str) -> str:
    """Points the store back to the version before the current one, and returns it; fails if there is none."""
    name, before = _pointer(spark, root)
    if not before or not _fs(spark, f"{root}/{before}")[0].exists(_fs(spark, f"{root}/{before}")[1]):
        raise ValueError("there is no version to go back to")
    _point(spark, root, before, name)
    return before


def _point(spark: SparkSession, root: str, name: str, before: str | None) -> None:
    """Replaces the pointer in one step."""
    fs, pointer, jvm = _fs(spark, f"{root}/_CURRENT")
    new = jvm.org.apache.hadoop.fs.Path(f"{root}/_CURRENT-{uuid.uuid4().hex}")
    out = fs.create(new, True)
    out.writeUTF(f"{name} {before or ''}")
    out.close()
    pointer, new = fs.makeQualified(pointer), fs.makeQualified(new)
    rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(pointer.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(new, pointer, how)


def _pointer(spark: SparkSession, root: str) -> tuple[str | None, str | None]:
    """The current version and the one before it."""
    fs, pointer, _ = _fs(spark, f"{root}/_CURRENT")
    if not fs.exists(pointer):
        return None, None
    stream = fs.open(pointer)
    try:
        name, before = stream.readUTF().split(" ")
    finally:
        stream.close()
    return name, before or None


def current(spark: SparkSession, root: str) -> str | None:
    """The version that readers of the store see."""
    return _pointer(spark, root)[0]


def load(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{current(spark, root)}")


def delta(old: DataFrame, new: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(upserts, removals) that turn old into new."""
    change = row_diff(old, new, keys)
    return new.join(change.where("change in ('added', 'changed')"), keys, "left_semi"), change.where("change = 'removed'").select(*keys)


def apply_delta(old: DataFrame, upserts: DataFrame, removals: DataFrame, keys: list[str]) -> DataFrame:
    gone = upserts.select(*keys).union(removals.select(*keys))
    return old.join(gone, keys, "left_anti").unionByName(upserts)


def snapshots(df: DataFrame, order: list[str], size: int = 128) -> DataFrame:
    """(batch, records, sha256, payload): rows in immutable batches of `size`, each one JSON array in order."""
    numbered = batches(df, order, size)
    rows = F.array_sort(F.collect_list(F.struct(*order, F.struct(*df.columns).alias("row"))))  # of `size` rows at most
    payload = F.to_json(F.transform(rows, lambda r: r["row"]))
    one = numbered.groupBy("batch").agg(F.count("*").alias("records"), payload.alias("payload"))
    return one.select("batch", "records", F.sha2("payload", 256).alias("sha256"), "payload")


def resume(done: DataFrame, planned: DataFrame) -> DataFrame:
    """The batches of planned that are not done; fails if one that is done holds something else."""
    if done.join(planned.select("batch", F.col("sha256").alias("__sha")), "batch").where("sha256 <> __sha").limit(1).count():
        raise ValueError("a batch that is done differs from what is planned")
    return planned.join(done.select("batch"), "batch", "left_anti")

