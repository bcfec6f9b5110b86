"""Stateful and streaming queries over events."""

from __future__ import annotations

import uuid

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glossa.plans.registry import query
from glossa.session import cut, ensure_checkpoint_dir, table
from glossa.streaming import folds, streams

_ANCHORED = """
WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) // 1000 AS ms FROM events), b AS (SELECT user_id, min(ms) AS anchor FROM e GROUP BY user_id UNION ALL SELECT b.user_id, min(e.ms) FROM b JOIN e ON e.user_id = b.user_id AND e.ms {op} b.anchor + {length} GROUP BY b.user_id, b.anchor),
w AS (SELECT e.user_id, e.event_id, e.ms, max(b.anchor) AS anchor FROM e JOIN b ON b.user_id = e.user_id AND b.anchor <= e.ms GROUP BY 1, 2, 3)
"""


def _events(spark, d):
    return table(spark, d, "events").select("user_id", "event_id", "event_type", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))


@query("state_rate_limit", "T01 T02", _ANCHORED.format(op=">", length=3600000) + "SELECT event_id, anchor, row_number() OVER (PARTITION BY user_id, anchor ORDER BY ms, event_id) AS nth, row_number() OVER (PARTITION BY user_id, anchor ORDER BY ms, event_id) <= 3 AS allowed FROM w")
def _(spark, d):
    w = folds.anchored_windows(_events(spark, d), "user_id", "ms", "event_id", 3600000, True)
    return w.select("event_id", "anchor", "nth", (F.col("nth") <= 3).alias("allowed"))


@query("state_ttl_cache", "T03", _ANCHORED.format(op=">=", length=86400000) + "SELECT user_id, count(*) FILTER (ms <> anchor) AS hits, count(DISTINCT anchor) AS misses FROM w GROUP BY user_id")
def _(spark, d):
    w = folds.anchored_windows(_events(spark, d), "user_id", "ms", "event_id", 86400000, False)
    return w.groupBy("user_id").agg(F.count_if(F.col("ms") != F.col("anchor")).alias("hits"), F.count_distinct("anchor").alias("misses"))


@query("state_fifo_cache", "T03")
def _(spark, d):
    e = _events(spark, d).withColumn("failed", F.col("event_type") == "error")
    return folds.fifo_cache(e, "event_type", "user_id", "ms", "event_id", 20, 86400000, "failed").select("event_id", "hit")


@query("state_cooldown", "T05", """
WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) // 1000 AS ms, event_type = 'error' AS bad, CASE WHEN event_id % 3 = 0 THEN 60 ELSE greatest(60, least(event_id % 100000, 86400)) END * 1000 AS wait FROM events),
a AS (SELECT user_id, min({'ms': ms, 'id': event_id, 'wait': wait}) AS s FROM e WHERE bad GROUP BY user_id
  UNION ALL SELECT a.user_id, min({'ms': e.ms, 'id': e.event_id, 'wait': e.wait}) FROM a JOIN e ON e.user_id = a.user_id AND e.bad AND e.ms >= a.s.ms + a.s.wait GROUP BY a.user_id, a.s)
SELECT e.event_id, count(a.s) > 0 AS skipped FROM e LEFT JOIN a ON a.user_id = e.user_id AND (a.s.ms < e.ms OR (a.s.ms = e.ms AND a.s.id < e.event_id)) AND e.ms < a.s.ms + a.s.wait GROUP BY e.event_id""")
def _(spark, d):
    status = F.when(F.col("event_id") % 3 == 0, 401).otherwise(429)
    e = _events(spark, d).withColumn("failed", F.col("event_type") == "error").withColumn("wait", folds.cooldown_millis(status, F.col("event_id") % 100000))
    return folds.cooldown(e, "user_id", "ms", "event_id", "failed", "wait").select("event_id", "skipped")


@query("state_latest", "T10 A13", "SELECT user_id, max(event_id) AS seq, max_by(event_type, event_id) AS result FROM events GROUP BY user_id")
def _(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.max("event_id").alias("seq"), F.max_by("event_type", "event_id").alias("result"))


@query("stream_rate_limit", "T01 T14", _ANCHORED.format(op=">", length=3600000) + "SELECT event_id, row_number() OVER (PARTITION BY user_id, anchor ORDER BY ms, event_id) <= 3 AS allowed FROM w")
def _(spark, d):
    out = streams.run_available(streams.rate_limited(streams.read_events(spark, f"{d}/events.parquet"), "user_id", 3600000, 3))
    return out.select("event_id", "allowed")


@query("stream_single_flight", "T04", "SELECT count(DISTINCT (user_id, event_type)) AS flights FROM events")
def _(spark, d):
    out = streams.run_available(streams.single_flight(streams.read_events(spark, f"{d}/events.parquet"), ["user_id", "event_type"], "400 days"))
    return out.agg(F.count("*").alias("flights"))


@query("stream_snapshots", "T06", "SELECT event_id, CAST(row_number() OVER (ORDER BY value DESC, event_id) AS INTEGER) AS pos FROM events QUALIFY pos <= 20")
def _(spark, d):
    seen: list[list] = []
    rank = lambda df: df.orderBy(F.desc("value"), "event_id")
    streams.run_available(streams.read_events(spark, f"{d}/events.parquet"), "append", streams.snapshots(seen, rank, "event_id"))
    last = seen[-1] if seen else []
    return spark.createDataFrame([(e, i + 1) for i, e in enumerate(last)], "event_id long, pos int")


@query("stream_lines", "K08 T09", """
WITH e AS (SELECT user_id, event_id, event_type, lag(event_type) OVER w AS before, lead(event_id) OVER w IS NULL AS done FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
k AS (SELECT * FROM e WHERE done OR before IS NULL OR before <> event_type)
SELECT user_id, CASE user_id % 5 WHEN 0 THEN 'no-final' WHEN 1 THEN 'after-final' WHEN 2 THEN 'malformed' WHEN 3 THEN 'oversized' END AS error, CASE WHEN user_id % 5 = 4 THEN max_by(event_type, event_id) END AS result, count(*) AS n FROM k GROUP BY user_id""")
def _(spark, d):
    lines = folds.to_lines(table(spark, d, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id", "event_type")
    n = lines.groupBy("user_id").agg(F.count("*").alias("n"))
    k = F.col("user_id") % 5
    # streams as they may arrive: cut short, gone on, broken, or with a line too long
    end = F.contains("line", F.lit('"done":true'))
    cut_short = F.when(end & (k == 0), F.replace("line", F.lit("true"), F.lit("false"))).when(end & (k == 2), '{"result":').when(end & (k == 3), F.concat("line", F.repeat(F.lit(" "), 200))).otherwise(F.col("line"))
    more = lines.where(end & (k == 1)).withColumn("event_id", F.col("event_id") + 1)
    told = folds.check_lines(lines.withColumn("line", cut_short).union(more), "user_id", "event_id", "line", 120)
    return told.join(n, "user_id")


@query("stream_ordered_lines", "T09 T10", """
WITH e AS (SELECT user_id, event_id, event_type, lag(event_type) OVER w AS before, lead(event_id) OVER w IS NULL AS done FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
k AS (SELECT * FROM e WHERE done OR before IS NULL OR before <> event_type)
SELECT user_id, CASE user_id % 5 WHEN 1 THEN 'after-final' WHEN 2 THEN 'malformed' WHEN 3 THEN 'oversized' END AS error, CASE WHEN user_id % 5 = 4 THEN max_by(event_type, event_id) END AS result,
  count(*) + CASE user_id % 5 WHEN 1 THEN 1 ELSE 0 END AS place FROM k WHERE user_id % 5 <> 0 GROUP BY user_id""")
def _(spark, d):
    said = folds.to_lines(table(spark, d, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id", "event_type")
    lines = said.select("user_id", F.row_number().over(W.partitionBy("user_id").orderBy("event_id")).cast("long").alias("place"), "line")
    k, end = F.col("user_id") % 5, F.contains("line", F.lit('"done":true'))
    broken = F.when(end & (k == 0), F.replace("line", F.lit("true"), F.lit("false"))).when(end & (k == 2), '{"result":').when(end & (k == 3), F.concat("line", F.repeat(F.lit(" "), 200))).otherwise(F.col("line"))
    lines = lines.withColumn("line", broken).union(lines.where(end & (k == 1)).withColumn("place", F.col("place") + 1))
    # lines come in three batches in which some are early, some late, and every fourth comes again
    folder, piece = f"{ensure_checkpoint_dir(spark)}/lines-{uuid.uuid4().hex}", F.pmod(F.xxhash64("user_id", "place"), F.lit(12))
    lines = cut(lines.withColumn("piece", piece))  # three batches are taken from it
    for i in range(3):
        came = lines.where((F.col("piece") % 3 == i) | (F.col("piece") % 4 == i)).drop("piece").withColumn("ts", F.timestamp_seconds(F.lit(1000 + i)))
        came.write.mode("append").parquet(f"{folder}/in")
        read = spark.readStream.schema("user_id long, place long, line string, ts timestamp").parquet(f"{folder}/in")
        # a run goes on from the last one's checkpoint and takes all files that are new as one batch
        told = streams.with_rocksdb(spark, lambda: streams.run_available(streams.ordered_lines(read, "user_id", 120), folder=folder))
    return told.groupBy("user_id").agg(F.max_by("error", "place").alias("error"), F.max_by("result", "place").alias("result"), F.max("place").alias("place"))


@query("window_tumbling_extension", "T06", """
SELECT epoch_us(date_trunc('hour', ts)) // 1000000 AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def _(spark, d):
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    w = e.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return w.select(F.unix_seconds("window.start").alias("hour"), "event_type", "n", "total")


@query("window_sessions_extension", "T01", """
WITH e AS (SELECT user_id, epoch_us(ts) AS us FROM events), s AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY user_id ORDER BY us) < 3600000000 THEN 0 ELSE 1 END AS new FROM e)
SELECT user_id, CAST(sum(new) AS BIGINT) AS sessions FROM s GROUP BY user_id""")
def _(spark, d):
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.groupBy("user_id", F.session_window("ts", "1 hour")).agg(F.count("*").alias("n")).groupBy("user_id").agg(F.count("*").alias("sessions"))
