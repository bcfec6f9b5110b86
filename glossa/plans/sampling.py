"""Windows, sorts, limits and samples."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glossa.operators import sample as s
from glossa.plans.registry import query
from glossa.session import table


@query("win_best_per_entity", "W01", """
SELECT l_partkey, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_discount, l_extendedprice DESC, l_orderkey, l_linenumber, l_suppkey) AS rn FROM lineitem) WHERE rn = 1""")
def _(spark, d):
    best = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.min(F.struct("l_discount", (-F.col("l_extendedprice")).alias("p"), "l_orderkey", "l_linenumber", "l_suppkey")).alias("b"))
    return best.select("l_partkey", "b.l_orderkey", "b.l_linenumber")


@query("win_string_order", "W07", "SELECT key, pos FROM (SELECT DISTINCT 'sense-' || l_linenumber AS key, dense_rank() OVER (ORDER BY 'sense-' || l_linenumber) AS pos FROM lineitem)")
def _(spark, d):
    keys = table(spark, d, "lineitem").select(F.concat(F.lit("sense-"), F.col("l_linenumber").cast("string")).alias("key")).distinct()
    return keys.select("key", F.row_number().over(W.orderBy("key")).cast("long").alias("pos"))


@query("win_flag_first", "W08 W16", "SELECT o_orderkey FROM orders ORDER BY o_orderstatus = 'P' DESC, o_orderkey LIMIT 50 OFFSET 10")
def _(spark, d):
    return table(spark, d, "orders").orderBy(F.desc(F.col("o_orderstatus") == "P"), "o_orderkey").offset(10).limit(50).select("o_orderkey")


@query("sample_hash", "W09", "SELECT doc_id FROM documents ORDER BY sha256(doc_id || 'salt') LIMIT 100")
def _(spark, d):
    return s.hash_sample(table(spark, d, "documents").select("doc_id"), F.col("doc_id"), "salt", 100)


@query("sample_stratified", "W10", "SELECT o_orderpriority, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS rn FROM orders) WHERE rn <= CASE WHEN o_orderpriority LIKE '1%' THEN 30 ELSE 10 END")
def _(spark, d):
    quota = F.when(F.col("o_orderpriority").startswith("1"), 30).otherwise(10)
    return s.stratified(table(spark, d, "orders"), ["o_orderpriority"], ["o_orderkey"], quota).select("o_orderpriority", "o_orderkey")


@query("sample_systematic", "W11", """
SELECT o_orderkey, rn FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS rn FROM orders) WHERE (rn - 1) % greatest(1, (SELECT count(*) FROM orders) // 100) = 0 AND rn <= 100 * greatest(1, (SELECT count(*) FROM orders) // 100)""")
def _(spark, d):
    return s.systematic(table(spark, d, "orders").select("o_orderkey"), ["o_orderkey"], 100)


@query("sample_round_robin", "W12", "SELECT p_partkey, p_brand, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS INTEGER) AS turn FROM part")
def _(spark, d):
    return s.round_robin(table(spark, d, "part").select("p_partkey", "p_brand"), "p_brand", ["p_partkey"])


@query("batch_fixed", "W13", "SELECT event_id, (row_number() OVER (ORDER BY event_id) - 1) // 128 AS batch FROM events")
def _(spark, d):
    return s.batches(table(spark, d, "events").select("event_id"), ["event_id"], 128)


@query("batch_split", "W14 W15 S16", """
WITH e AS (SELECT event_id, row_number() OVER (ORDER BY event_id) AS rn FROM events), n AS (SELECT CAST(floor(count(*) * 0.4) AS BIGINT) AS first FROM events)
SELECT event_id, rn, CAST(rn > first AS INTEGER) AS side FROM e, n""")
def _(spark, d):
    return s.split_at(table(spark, d, "events").select("event_id"), ["event_id"], 0.4)


@query("win_running_offsets", "W14 S16", """
SELECT l_suppkey, n, CAST(sum(n) OVER (ORDER BY l_suppkey) - n AS BIGINT) AS offset_, lag(n) OVER (ORDER BY l_suppkey) AS before FROM (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1)""")
def _(spark, d):
    c = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"))
    w = W.orderBy("l_suppkey")  # one row a supplier
    return c.select("l_suppkey", "n", (F.sum("n").over(w) - F.col("n")).alias("offset_"), F.lag("n").over(w).alias("before"))


@query("win_rotating_pick", "W17 W18", """
WITH p AS (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS i FROM part), n AS (SELECT count(*) AS n FROM part), days AS (SELECT unnest(range(19700, 19710)) AS day)
SELECT day, p_partkey FROM days, n JOIN p ON true WHERE p.i = day % n""".replace("days, n JOIN p ON true", "days CROSS JOIN n JOIN p ON p.i = days.day % n.n").replace(" WHERE p.i = day % n", ""))
def _(spark, d):
    p = s.numbered(table(spark, d, "part").select("p_partkey"), ["p_partkey"]).withColumn("i", F.col("rn") - 1)
    n = table(spark, d, "part").count()
    days = spark.range(19700, 19710).select(F.col("id").alias("day"), F.pmod("id", F.lit(n)).alias("i"))
    return days.join(p, "i").select("day", "p_partkey")


@query("win_insert_at", "W18", "SELECT n_nationkey, list_concat(['a', 'b', 'c'][1:(n_nationkey % 4)], [n_name], ['a', 'b', 'c'][(n_nationkey % 4) + 1:]) AS options FROM nation")
def _(spark, d):
    three = F.array(F.lit("a"), F.lit("b"), F.lit("c"))
    return table(spark, d, "nation").select("n_nationkey", F.array_insert(three, (F.col("n_nationkey") % 4 + 1).cast("int"), F.col("n_name")).alias("options"))


@query("win_recent_distinct", "W19 T10", """
SELECT user_id, event_type, rk FROM (SELECT user_id, event_type, CAST(row_number() OVER (PARTITION BY user_id ORDER BY max(event_id) DESC) AS INTEGER) AS rk FROM events GROUP BY user_id, event_type) WHERE rk <= 6""")
def _(spark, d):
    last = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.max("event_id").alias("last"))
    return last.withColumn("rk", F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("last")))).where("rk <= 6").select("user_id", "event_type", "rk")


@query("win_retained_order", "W24", """
SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN event_id % 3 = 0 THEN event_id ELSE 1000000000 END, event_id) AS INTEGER) AS pos FROM events""")
def _(spark, d):
    kept = F.when(F.col("event_id") % 3 == 0, F.col("event_id")).otherwise(1000000000)
    return table(spark, d, "events").select("user_id", "event_id", F.row_number().over(W.partitionBy("user_id").orderBy(kept, "event_id")).alias("pos"))


@query("sample_capped_groups", "A08 W10", """
SELECT source, count(*) AS n, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) FILTER (rn <= 12) AS sample FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents) GROUP BY source""")
def _(spark, d):
    docs = table(spark, d, "documents").select("source", "doc_id")
    few = s.stratified(docs, ["source"], ["doc_id"], 12).groupBy("source").agg(F.array_join(F.transform(F.array_sort(F.collect_list("doc_id")), lambda x: x.cast("string")), ",").alias("sample"))
    return docs.groupBy("source").agg(F.count("*").alias("n")).join(few, "source")
