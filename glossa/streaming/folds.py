"""Sequential folds over a key's events, without a key's events ever being in one place at once.

Rows are hash-partitioned by key and sorted by key and time; a task walks its rows batch by
batch and carries one small state for the key it is at. A key that holds a third of all rows
makes one long walk, in constant memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def anchored_windows(events: DataFrame, key: str, millis: str, order: str, length: int, inclusive: bool) -> DataFrame:
    """Events with `anchor` (start of their window), and `nth` in it.

    A window opens at a key's first event after the last one has ended, lasts `length`
    milliseconds, and is not extended by events. inclusive: an event exactly at the end still
    belongs to it.
    """
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in events.schema)

    def walk(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, anchor, n = None, 0, 0
        for pdf in parts:
            anchors, nths = [], []
            for k, t in zip(pdf[key], pdf[millis]):
                if k != at or (t > anchor + length if inclusive else t >= anchor + length):
                    at, anchor, n = k, t, 0
                n += 1
                anchors.append(anchor)
                nths.append(n)
            yield pdf.assign(anchor=anchors, nth=nths)

    sorted_ = events.where(f"{key} is not null").repartition(key).sortWithinPartitions(key, millis, order)
    return sorted_.mapInPandas(walk, f"{fields}, anchor long, nth long")


def cooldown(events: DataFrame, key: str, millis: str, order: str, failed: str, wait: str) -> DataFrame:
    """Events with `skipped`: whether they fall into the pause that the last failure of their key asked for.

    A failure inside a pause is not tried and does not prolong it.
    """
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in events.schema)

    def walk(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, until = None, -1
        for pdf in parts:
            out = []
            for k, t, bad, w in zip(pdf[key], pdf[millis], pdf[failed], pdf[wait]):
                if k != at:
                    at, until = k, -1
                skip = t < until
                if not skip and bad:
                    until = t + w
                out.append(skip)
            yield pdf.assign(skipped=out)

    sorted_ = events.where(f"{key} is not null").repartition(key).sortWithinPartitions(key, millis, order)
    return sorted_.mapInPandas(walk, f"{fields}, skipped boolean")


def cooldown_millis(status: Column, retry_after: Column) -> Column:
    """How long a failed answer stops its provider: a refusal for its rate, between a minute and a day as it asks
    (a minute if it does not); a refusal of the credentials, a minute; any other answer, not at all (null)."""
    wait = F.greatest(F.lit(60), F.least(F.coalesce(retry_after.cast("long"), F.lit(60).cast("long")), F.lit(86400)))
    return (F.when(status == 429, wait).when(status.isin(401, 403), 60) * 1000).cast("long")


def fifo_cache(events: DataFrame, cache: str, key: str, millis: str, order: str, capacity: int, ttl: int, failed: str | None = None, failure_ttl: int = 60_000) -> DataFrame:
    """Events with `hit`: whether a cache of `capacity` entries holds the event's key at its time.

    A miss puts the key in, last in line, for `ttl` milliseconds, or `failure_ttl` if the event
    failed; a full cache then drops the entry that was put in first. A hit changes nothing; an
    entry found expired leaves. Caches are walked one after another in constant memory.
    """
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in events.schema)

    def walk(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held = None, {}
        for pdf in parts:
            out = []
            bad = pdf[failed] if failed else [False] * len(pdf)
            for c, k, t, f in zip(pdf[cache], pdf[key], pdf[millis], bad):
                if c != at:
                    at, held = c, {}
                hit = held.get(k, -1) > t
                if not hit:
                    held.pop(k, None)
                    held[k] = t + (failure_ttl if f else ttl)
                    if len(held) > capacity:
                        del held[next(iter(held))]
                out.append(hit)
            yield pdf.assign(hit=out)

    sorted_ = events.where(f"{cache} is not null").repartition(cache).sortWithinPartitions(cache, millis, order)
    return sorted_.mapInPandas(walk, f"{fields}, hit boolean")


def to_lines(snapshots: DataFrame, stream: str, order: str, result: str) -> DataFrame:
    """(stream, order, line): snapshots as lines of JSON {result, done}. A snapshot like the one before it is left
    out, but the last of a stream always comes, and only it is done."""
    w = W.partitionBy(stream).orderBy(order)
    rows = snapshots.withColumn("__before", F.lag(F.struct(result)).over(w)).withColumn("done", F.lead(F.lit(1)).over(w).isNull())
    rows = rows.where(F.col("done") | F.col("__before").isNull() | ~F.col(f"__before.{result}").eqNullSafe(F.col(result)))
    return rows.select(stream, order, F.to_json(F.struct(F.col(result).alias("result"), "done"), {"ignoreNullFields": "false"}).alias("line"))


def check_lines(lines: DataFrame, stream: str, order: str, line: str, most: int = 1 << 20) -> DataFrame:
    """(stream, error, result): what the lines of a stream end in, or why it is refused: a line over `most` bytes,
    one that is no JSON object, no final line, or a line after it. A partially aggregated fold; no stream is collected."""
    bad = F.get_json_object(line, "$.done").isNull()
    done = F.get_json_object(line, "$.done") == "true"
    last = F.max_by(F.get_json_object(line, "$.result"), F.col(order))
    told = lines.groupBy(stream).agg(F.max(F.octet_length(line)).alias("size"), F.max(bad).alias("bad"), F.min(F.when(done, F.col(order))).alias("final"), F.max(order).alias("end"), last.alias("last"))
    error = F.when(F.col("size") > most, "oversized").when(F.col("bad"), "malformed").when(F.col("final").isNull(), "no-final").when(F.col("final") < F.col("end"), "after-final")
    return told.select(stream, error.alias("error"), F.when(error.isNull(), F.col("last")).alias("result"))
