"""Session set-up and the folders that all executors share."""

from __future__ import annotations

import functools
import hashlib
import os
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "glossa", cpus: int | str = 8, **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Let Python workers that share this machine's disk import the package; clusters install it."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)


def shipped(query):
    """The query, run after ship()."""

    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder: the cluster's own, or, where none is set and all runs on this machine (tests), one of ours."""
    given = spark.conf.get("spark.checkpoint.dir", "") or ""
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isDefined():
        return jsc.getCheckpointDir().get()
    if not given and not (spark.sparkContext.master + "[").startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(given or os.path.join(tempfile.gettempdir(), "checkpoints"))
    return jsc.getCheckpointDir().get()


def remove(spark: SparkSession, path: str) -> None:
    """Removes a file or folder through the file system that holds it."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def kept(spark: SparkSession, inputs: list[str], name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """build(), written once to the shared folder for the input files as they are now, and read from there from then on.

    Files that change their length or time give another name, so no answer comes from old data.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    stamps = []
    for i in inputs:
        p = jvm.org.apache.hadoop.fs.Path(i)
        fs = p.getFileSystem(conf)
        stamps += [(f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in fs.listStatus(p)]
    path = f"{ensure_checkpoint_dir(spark)}/kept-{name}-{hashlib.sha256(repr(sorted(stamps)).encode()).hexdigest()[:32]}"
    done = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(conf).exists(done):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and go on from there.

    A reliable checkpoint outlives lost executors, is computed once, and its files go
    when no plan refers to them any more (spark.cleaner.referenceTracking.cleanCheckpoints).
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: A side of a join with so many rows or fewer is broadcast.
FEW_ROWS = 10_000


def paired(side: DataFrame, few: int | None = None) -> DataFrame:
    """side, hinted for the join it goes into: a broadcast after a count of `few` rows or fewer, else a merge join.

    Without a hint Spark judges either side by the size of the file that it comes from, and what explode() or rounds
    make of a small file is then gathered on the driver.
    """
    few = FEW_ROWS if few is None else few
    return side.hint("broadcast" if side.limit(few + 1).count() <= few else "merge")


def spread(df: DataFrame, key: str) -> DataFrame:
    """df dealt by a key of even spread over as many tasks as a shuffle has, for work that costs much a row: a small file
    of very many rows is read by one task or two, which would do all of it."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)
