"""Versioned-store queries over orders and customers."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from glossa.operators import quality, store, versions
from glossa.plans.registry import query
from glossa.session import ensure_checkpoint_dir, table


@query("store_build", "M01 J06 A12", """
WITH e AS (SELECT o_orderkey AS k, o_orderstatus AS v, 0 AS prio FROM orders WHERE o_orderkey % 2 = 0), c AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE 'N' END AS v, 1 AS prio FROM orders WHERE o_orderkey % 3 = 0), live AS (SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 5 <> 0),
r AS (SELECT *, CASE WHEN k NOT IN (SELECT k FROM live) THEN 'stale' WHEN v = '' THEN 'rejected' ELSE 'accepted' END AS fate FROM (SELECT * FROM e UNION ALL SELECT * FROM c))
SELECT fate, v, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY k, fate ORDER BY prio) AS rn FROM r) WHERE fate <> 'accepted' OR rn = 1 GROUP BY fate, v""")
def _(spark, d):
    o = table(spark, d, "orders")
    e = o.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("v"))
    c = o.where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("k"), F.when(F.col("o_orderkey") % 7 == 0, "").otherwise("N").alias("v"))
    live = o.where("o_orderkey % 5 <> 0").select(F.col("o_orderkey").alias("k"))
    return store.build(e, c, live, ["k"], quality.issues({"empty": F.col("v") == ""})).groupBy("fate", "v").agg(F.count("*").alias("n"))


@query("store_upsert", "M02", """
SELECT c_custkey AS k, CASE WHEN c_custkey % 4 = 0 THEN true ELSE c_custkey % 3 = 0 END AS verified, CASE WHEN c_custkey % 4 = 0 AND c_custkey % 3 <> 0 THEN 'new' ELSE c_mktsegment END AS v FROM customer UNION ALL SELECT -c_custkey, false, 'added' FROM customer WHERE c_custkey % 10 = 1""")
def _(spark, d):
    c = table(spark, d, "customer")
    base = c.select(F.col("c_custkey").alias("k"), (F.col("c_custkey") % 3 == 0).alias("verified"), F.col("c_mktsegment").alias("v"))
    update = c.where("c_custkey % 4 = 0").select(F.col("c_custkey").alias("k"), F.lit(True).alias("verified"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_mktsegment")).otherwise("new").alias("v"))
    weak = c.where("c_custkey % 4 = 2").select(F.col("c_custkey").alias("k"), F.lit(False).alias("verified"), F.col("c_mktsegment").alias("v"))
    added = c.where("c_custkey % 10 = 1").select((-F.col("c_custkey")).alias("k"), F.lit(False).alias("verified"), F.lit("added").alias("v"))
    return store.protected_upsert(base, update.union(weak).union(added), ["k"], "verified", ["v"])


@query("store_insert_only", "M03 J04", "SELECT c_custkey AS k, 'old' AS v FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, 'new' FROM customer WHERE c_custkey % 2 <> 0 AND c_custkey % 3 = 0")
def _(spark, d):
    c = table(spark, d, "customer")
    base = c.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k"), F.lit("old").alias("v"))
    more = c.where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("k"), F.lit("new").alias("v"))
    return store.insert_only(store.insert_only(base, more, ["k"]), more, ["k"])


@query("store_enrich", "M04 M06 J02", "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'own' WHEN s_suppkey IS NOT NULL THEN s_name END AS label FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey")
def _(spark, d):
    base = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, "own").alias("label"))
    extra = table(spark, d, "supplier").select(F.col("s_suppkey").alias("c_custkey"), F.col("s_name").alias("label"))
    return store.enrich(base, extra, ["c_custkey"], ["label"])


@query("store_partition", "M05 V03", """
SELECT label, count(*) AS n FROM (SELECT CASE WHEN o_totalprice < 20000 THEN 'quarantine' WHEN o_orderkey % 3 <> 0 THEN 'new' WHEN o_orderkey % 2 = 0 THEN 'same' ELSE 'additional' END AS label FROM orders) GROUP BY label""")
def _(spark, d):
    o = table(spark, d, "orders")
    have = o.where("o_orderkey % 3 = 0").select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderstatus")).otherwise("x").alias("o_orderstatus"))
    c = o.select("o_orderkey", "o_orderstatus", "o_totalprice")
    return store.partition_candidates(have, c, ["o_orderkey"], "o_orderstatus", quality.issues({"cheap": F.col("o_totalprice") < 20000})).groupBy("label").agg(F.count("*").alias("n"))


@query("store_delta", "K04 M07 J17", """
SELECT 'upsert' AS kind, count(*) AS n FROM orders WHERE o_orderkey % 10 IN (1, 3) UNION ALL SELECT 'removal', count(*) FROM orders WHERE o_orderkey % 10 = 2 UNION ALL SELECT 'unlike', 0""")
def _(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    old = o.where("o_orderkey % 10 <> 1")
    new = o.where("o_orderkey % 10 <> 2").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 10 == 3, "X").otherwise(F.col("o_orderstatus")))
    up, gone = store.delta(old, new, ["o_orderkey"])
    unlike = store.apply_delta(old, up, gone, ["o_orderkey"]).exceptAll(new)
    parts = [df.agg(F.lit(name).alias("kind"), F.count("*").alias("n")) for name, df in (("upsert", up), ("removal", gone), ("unlike", unlike))]
    return parts[0].union(parts[1]).union(parts[2])


@query("store_drift", "M08", "SELECT n_regionkey, count(*) AS n, true AS unchanged FROM nation GROUP BY n_regionkey")
def _(spark, d):
    def manifest(df):
        return df.groupBy("n_regionkey").agg(F.count("*").alias("n"), F.sum(F.xxhash64("n_nationkey", "n_name").cast("decimal(38,0)")).alias("digest"))

    n = table(spark, d, "nation")
    then, now = manifest(n), manifest(n.repartition(3)).withColumnRenamed("digest", "now").drop("n")
    return then.join(now, "n_regionkey").select("n_regionkey", "n", F.col("digest").eqNullSafe(F.col("now")).alias("unchanged"))


@query("store_version_diff", "J17 M07 M08 A21", """
SELECT o_orderkey, CASE WHEN o_orderkey % 500 = 2 THEN 'removed' ELSE 'changed' END AS change FROM orders WHERE o_orderkey % 500 IN (2, 3)
UNION ALL SELECT -o_orderkey, 'added' FROM orders WHERE o_orderkey % 500 = 4""")
def _(spark, d):
    o, root = table(spark, d, "orders"), f"{ensure_checkpoint_dir(spark)}/versions-{uuid.uuid4().hex}"
    new = o.where("o_orderkey % 500 <> 2").withColumn("o_totalprice", F.col("o_totalprice") + F.when(F.col("o_orderkey") % 500 == 3, 1.0).otherwise(0.0))
    new = new.union(o.where("o_orderkey % 500 = 4").withColumn("o_orderkey", -F.col("o_orderkey")))
    buckets = versions.buckets_for(o.count())
    for df, name in ((o, "old"), (new, "new")):
        versions.write(df, f"{root}/{name}", ["o_orderkey"], buckets)
    return versions.diff(spark, f"{root}/old", f"{root}/new", ["o_orderkey"], buckets)
