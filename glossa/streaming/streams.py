"""Structured Streaming forms of the stateful operators, with event time and watermarks."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from glossa.session import ensure_checkpoint_dir


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """The events table as a stream of its files."""
    schema = spark.read.parquet(path).schema
    folder, name = path.rsplit("/", 1)
    return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def run_available(df: DataFrame, mode: str = "append", each: Callable[[DataFrame, int], None] | None = None, folder: str | None = None) -> DataFrame | None:
    """Runs a stream over what is there, with a checkpoint in the shared folder, and returns what it wrote.

    A folder that is given again goes on from its checkpoint and returns all that was written to it."""
    spark = df.sparkSession
    folder = folder or f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    writer = df.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{folder}/state").outputMode(mode)
    if each is not None:
        writer.foreachBatch(each).start().awaitTermination()
        return None
    writer.format("parquet").option("path", f"{folder}/out").start().awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{folder}/out")


def rate_limited(events: DataFrame, key: str, length_ms: int, most: int, delay: str = "1 hour") -> DataFrame:
    """T01 as a stream: (key, event_id, allowed), windows anchored at a key's first event after the last has ended.

    A key's state goes once the watermark has passed the end of its window.
    """

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        anchor, n = state.get if state.exists else (None, 0)
        rows = pd.concat(list(parts)).sort_values(["ms", "event_id"])
        allowed = []
        for t in rows["ms"]:
            if anchor is None or t > anchor + length_ms:
                anchor, n = int(t), 0
            n += 1
            allowed.append(n <= most)
        state.update((anchor, n))
        state.setTimeoutTimestamp(max(anchor + length_ms, state.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame({key: rows[key], "event_id": rows["event_id"], "allowed": allowed})

    rows = events.withWatermark("ts", delay).select(key, "event_id", "ts", F.unix_millis("ts").alias("ms"))
    return rows.groupBy(key).applyInPandasWithState(step, f"{key} long, event_id long, allowed boolean", "anchor long, n long", "append", GroupStateTimeout.EventTimeTimeout)


def single_flight(events: DataFrame, keys: list[str], delay: str = "60 seconds") -> DataFrame:
    """Of requests with equal keys within the watermark's delay, the first."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys)


def tumbling(events: DataFrame, length: str, delay: str) -> DataFrame:
    """Extension: counts and sums of event-time windows, final once the watermark passes them."""
    w = events.withWatermark("ts", delay).groupBy(F.window("ts", length), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return w.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def snapshots(sink: list[list], rank: Callable[[DataFrame], DataFrame], id_col: str, k: int = 20):
    """A foreachBatch function that ranks all rows so far and appends the top k ids to sink, if they changed.

    What it keeps is at most k rows a batch: a later top k can only hold rows of the last one and new rows.
    """
    state: dict[str, DataFrame | None] = {"best": None}

    def each(batch: DataFrame, _: int) -> None:
        rows = batch if state["best"] is None else batch.unionByName(state["best"])
        top = rank(rows).limit(k)
        held = top.collect()  # k rows
        state["best"] = batch.sparkSession.createDataFrame(held, batch.schema) if held else None
        ids = [r[id_col] for r in held]
        if not sink or sink[-1] != ids:
            sink.append(ids)

    return each


class _OrderedLines(StatefulProcessor):
    """A stream's state: what it has come to, and, by place, the lines that came before those they follow."""

    def __init__(self, stream: str, most: int, patience_ms: int) -> None:
        self.stream, self.most, self.patience = stream, most, patience_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.told = handle.getValueState("told", "next long, done boolean, error string, result string")
        self.early = handle.getMapState("early", "place long", "line string")

    def handleInputRows(self, key, rows, timerValues):
        at, done, error, result = self.told.get() if self.told.exists() else (1, False, None, None)
        came, last = {}, 0
        for pdf in rows:
            last = max([last, *pdf["ms"]])
            came.update((int(p), line) for p, line in zip(pdf["place"], pdf["line"]) if p >= at)  # others were taken before
        begun = at
        waiting = {place[0] for place in self.early.keys()}  # asked at once, not line by line
        while error is None:
            line = came.pop(at, None)
            if at in waiting:
                line = self.early.getValue((at,))[0] if line is None else line
                self.early.removeKey((at,))
            if line is None:
                break
            at += 1
            done, error, result = self._after(done, line)
        if error is None:
            for place, line in came.items():
                self.early.updateValue((place,), (line,))
        elif waiting:
            self.early.clear()
        self.told.update((at, done, error, result))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(int(last) + self.patience)
        if at > begun and (done or error):
            yield self._verdict(key, at - 1, error, result)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        at, done, error, _ = self.told.get()
        self.told.clear()
        if self.early.exists():
            self.early.clear()
        if not done and error is None:
            yield self._verdict(key, at, "no-final", None)

    def _after(self, done: bool, line: str) -> tuple[bool, str | None, str | None]:
        """What a stream has come to with its next line."""
        if done:
            return done, "after-final", None
        if len(line.encode()) > self.most:
            return done, "oversized", None
        try:
            said = json.loads(line)
            return bool(said["done"]), None, said["result"] if said["done"] else None
        except (ValueError, KeyError, TypeError):
            return done, "malformed", None

    def _verdict(self, key, place: int, error: str | None, result: str | None) -> pd.DataFrame:
        return pd.DataFrame({self.stream: [key[0]], "place": [place], "error": [error], "result": [result]})


def ordered_lines(lines: DataFrame, stream: str, most: int = 1 << 20, patience_ms: int = 60_000, delay: str = "60 seconds") -> DataFrame:
    """T09, T10 as a stream: (stream, place, error, result) whenever the lines of a stream come to an end.

    lines holds the stream's key (a long), `place` (from 1), `line` and `ts`. Lines may come late, early or again, in any
    micro-batch: each is read once and in its place, early ones wait in state. A final line gives its result; a line over
    `most` bytes, one that is no JSON object of {result, done}, or one after the final line ends the stream with an error, the
    latter after its result was given: the verdict of the largest place holds. A stream that says nothing for `patience_ms` of
    event time leaves the state, with `no-final` if it had no end. It needs the RocksDB state store (`with_rocksdb`).
    """
    rows = lines.withWatermark("ts", delay).select(stream, "place", "line", "ts", F.unix_millis("ts").alias("ms"))
    return rows.groupBy(stream).transformWithStateInPandas(_OrderedLines(stream, most, patience_ms), f"{stream} long, place long, error string, result string", "Append", "EventTime")


def with_rocksdb(spark: SparkSession, run: Callable[[], DataFrame]) -> DataFrame:
    """run() with the state store that states of several variables need; the session's own one is set again after it."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        return run()
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)
