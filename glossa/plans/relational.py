"""Projections, joins, aggregations, set operations and graphs."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glossa.functions import text as t
from glossa.operators import graph, joins, sample, selection
from glossa.operators.validate import corpus_audit
from glossa.plans.registry import query
from glossa.session import table

# projections and filters
@query("proj_senses", "P01 A04", """
WITH s AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: NOT regexp_matches(lower(x), '^the')) AS ls FROM documents)
SELECT doc_id, 'sense-' || i AS sense_id, sha256('[' || to_json(CAST(doc_id AS VARCHAR)) || ',' || i || ',' || to_json(l) || ']') AS key
FROM (SELECT doc_id, unnest(ls) AS l, generate_subscripts(ls, 1) - 1 AS i FROM s)""")
def _(spark, d):
    lines = F.filter(F.split("text", "\n"), lambda x: ~F.lower(x).rlike("^the"))
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(lines).alias("i", "l"))
    return rows.select("doc_id", F.concat(F.lit("sense-"), F.col("i").cast("string")).alias("sense_id"), t.sense_key(F.col("doc_id").cast("string"), F.col("i"), F.col("l")).alias("key"))


@query("proj_whitelist", "P03 P04", """
SELECT o_orderkey, '{"key":' || o_orderkey || CASE WHEN o_orderstatus = 'F' THEN ',"status":"F"' ELSE '' END || '}' AS record FROM orders""")
def _(spark, d):
    o = table(spark, d, "orders").drop("o_orderdate", "o_totalprice")
    return o.select("o_orderkey", F.to_json(F.struct(F.col("o_orderkey").alias("key"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderstatus")).alias("status"))).alias("record"))


@query("proj_case_cascade", "P07 P08", """
SELECT p_partkey, CASE WHEN regexp_matches(p_type, 'STEEL|BRASS|TIN') THEN 'metal' WHEN p_size > 25 THEN 'large' WHEN p_brand = 'Brand#1' THEN 'first' ELSE 'other' END AS category FROM part""")
def _(spark, d):
    c = F.when(F.col("p_type").rlike("STEEL|BRASS|TIN"), "metal").when(F.col("p_size") > 25, "large").when(F.col("p_brand") == "Brand#1", "first").otherwise("other")
    return table(spark, d, "part").select("p_partkey", c.alias("category"))


@query("proj_rule_table", "P09 P06 S19", """
WITH rules(prio, pattern, label) AS (VALUES (1, '\\d{3}-\\d{4}', 'phone'), (2, '@', 'mail'), (3, '\\|', 'table'), (4, 'the', 'english'))
SELECT doc_id, (SELECT label FROM rules WHERE regexp_matches(text, pattern) ORDER BY prio LIMIT 1) AS label FROM documents""")
def _(spark, d):
    rules = [(r"\d{3}-\d{4}", "phone"), ("@", "mail"), (r"\|", "table"), ("the", "english")]
    label = F.coalesce(*[F.when(F.col("text").rlike(p), F.lit(name)) for p, name in rules])
    return table(spark, d, "documents").select("doc_id", label.alias("label"))


@query("proj_turns_nested", "P02 P17", """
SELECT conv_id, max(turn) FILTER (role = 'assistant') AS last_reply, count(*) AS n, COALESCE(min(turn) FILTER (role = 'assistant'), min(turn)) AS picked FROM conversations GROUP BY conv_id""")
def _(spark, d):
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.collect_list(F.struct("turn", "role")).alias("turns"))
    replies = F.transform(F.filter("turns", lambda x: x["role"] == "assistant"), lambda x: x["turn"])
    return c.select("conv_id", F.array_max(replies).alias("last_reply"), F.size("turns").cast("long").alias("n"), F.coalesce(F.array_min(replies), F.array_min(F.transform("turns", lambda x: x["turn"]))).alias("picked"))


@query("proj_request_check", "P16 P05 P14", """
SELECT event_type, count(*) AS n, count(*) FILTER (regexp_matches(event_type, '^[a-z_]{1,20}$') AND user_id BETWEEN 1 AND 500) AS valid FROM events WHERE event_type NOT IN ('error') GROUP BY event_type""")
def _(spark, d):
    ok = F.col("event_type").rlike("^[a-z_]{1,20}$") & F.col("user_id").between(1, 500)
    return table(spark, d, "events").where(~F.col("event_type").isin("error")).groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(ok).alias("valid"))


# joins
@query("join_overlay", "J01 J02 A13", """
WITH o AS (SELECT c_custkey, o_orderpriority AS prio, o_orderstatus AS st FROM (SELECT o_custkey AS c_custkey, *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1)
SELECT c.c_custkey, CASE WHEN c.c_custkey % 3 = 0 THEN 'own' WHEN st = 'O' THEN prio END AS label FROM customer c LEFT JOIN o USING (c_custkey)""")
def _(spark, d):
    base = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, "own").alias("label"))
    over = table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return joins.guarded_overlay(base, over, ["c_custkey"], F.col("__o_o_orderstatus") == "O", {"label": "o_orderpriority"}, [F.col("o_orderdate"), F.col("o_orderkey")])


@query("join_lookup", "J03 J06", """
SELECT o_orderpriority, count(*) AS n_lines, round(sum(l_quantity), 2) AS qty FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_orderpriority""")
def _(spark, d):
    j = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return j.groupBy("o_orderpriority").agg(F.count("*").alias("n_lines"), F.round(F.sum("l_quantity"), 2).alias("qty"))


@query("join_anti", "J04 U04", "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def _(spark, d):
    big = table(spark, d, "orders").where("o_totalprice > 300000")
    return table(spark, d, "customer").join(big, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


@query("join_semi", "J05", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def _(spark, d):
    p = table(spark, d, "orders").where("o_orderstatus = 'P'")
    return table(spark, d, "customer").join(p, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_mktsegment")


@query("join_stale_split", "J06 M05", """
SELECT CASE WHEN o_orderkey IS NULL THEN 'stale' ELSE 'live' END AS side, count(*) AS n FROM lineitem LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus <> 'P') ON l_orderkey = o_orderkey GROUP BY 1""")
def _(spark, d):
    o = table(spark, d, "orders").where("o_orderstatus <> 'P'").select("o_orderkey")
    j = table(spark, d, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return j.groupBy(F.when(F.col("o_orderkey").isNull(), "stale").otherwise("live").alias("side")).agg(F.count("*").alias("n"))


@query("join_editorial", "J07 J22", """
SELECT n.n_nationkey, e.label FROM nation n JOIN (SELECT r_regionkey, min_by(label, prio) AS label FROM (SELECT r_regionkey, r_name AS label, 2 AS prio FROM region UNION ALL SELECT r_regionkey, 'first', 1 FROM region WHERE r_regionkey = 0) GROUP BY 1) e ON n.n_regionkey = e.r_regionkey""")
def _(spark, d):
    r = table(spark, d, "region")
    e = r.select("r_regionkey", F.col("r_name").alias("label"), F.lit(2).alias("prio")).union(r.where("r_regionkey = 0").select("r_regionkey", F.lit("first"), F.lit(1)))
    e = joins.keep_first(e, ["r_regionkey"], ["prio"])
    return table(spark, d, "nation").join(e, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "label")


@query("join_parent_children", "J08 A02", """
SELECT o_orderkey, count(l_linenumber) AS n, string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_linenumber, l_partkey) AS parts FROM orders JOIN lineitem ON o_orderkey = l_orderkey AND l_quantity > 25 WHERE o_orderstatus = 'F' GROUP BY o_orderkey""")
def _(spark, d):
    kids = table(spark, d, "lineitem").where("l_quantity > 25").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("k"))
    o = table(spark, d, "orders").where("o_orderstatus = 'F'")
    return o.join(kids, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", F.size("k").cast("long").alias("n"), F.array_join(F.transform("k", lambda x: x["l_partkey"].cast("string")), ",").alias("parts"))


@query("join_division", "J09 J10 J11 J12", """
WITH want AS (SELECT DISTINCT p_type AS need, p_size // 10 AS member FROM part), have AS (SELECT DISTINCT l_suppkey AS grp, p_size // 10 AS member FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity < 3),
size AS (SELECT need, count(*) AS k FROM want GROUP BY need), met AS (SELECT need, grp, count(*) AS k FROM have JOIN want USING (member) GROUP BY need, grp)
SELECT met.need, met.grp FROM met JOIN size ON met.need = size.need AND met.k = size.k""")
def _(spark, d):
    # suppliers that delivered, in small lots, parts of every size class that a type comes in
    part = table(spark, d, "part").select("p_partkey", "p_type", F.expr("p_size div 10").alias("member"))
    small = table(spark, d, "lineitem").where("l_quantity < 3").select(F.col("l_partkey").alias("p_partkey"), F.col("l_suppkey").alias("grp"))
    return joins.divide(small.join(part, "p_partkey"), "grp", "member", part.withColumnRenamed("p_type", "need"))


@query("join_unique_match", "J09 J22", """
SELECT c_nationkey AS need, min(s_suppkey) AS s_suppkey FROM (SELECT DISTINCT c_nationkey, s_suppkey FROM customer JOIN supplier ON c_nationkey = s_nationkey WHERE s_acctbal > 5000) GROUP BY 1 HAVING count(*) = 1""")
def _(spark, d):
    m = table(spark, d, "customer").join(table(spark, d, "supplier").where("s_acctbal > 5000"), F.col("c_nationkey") == F.col("s_nationkey"))
    return joins.only_match(m.select(F.col("c_nationkey").alias("need"), "s_suppkey"), "need")


@query("join_anti_list", "J14 V05", """
SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' AND o_orderpriority LIKE '1%' THEN 'pair' WHEN o_orderpriority LIKE '5%' THEN 'term' END AS reason FROM orders""")
def _(spark, d):
    o = table(spark, d, "orders").withColumn("p", F.left("o_orderpriority", F.lit(1)))
    pairs = spark.createDataFrame([("F", "1", "pair")], "o_orderstatus string, p string, by_pair string")
    terms = spark.createDataFrame([("5", "term")], "p string, by_term string")
    j = o.join(F.broadcast(pairs), ["o_orderstatus", "p"], "left").join(F.broadcast(terms), "p", "left")  # rule tables of fixed size
    return j.select("o_orderkey", F.coalesce("by_pair", "by_term").alias("reason"))


@query("join_ordinal_zip", "J15 S15", """
WITH e AS (SELECT event_id, user_id, row_number() OVER (ORDER BY event_id) AS i FROM events) SELECT a.i, a.event_id, a.user_id = b.user_id AS aligned FROM e a JOIN (SELECT i, user_id + CASE WHEN i % 10 = 0 THEN 1 ELSE 0 END AS user_id FROM e) b ON a.i = b.i""")
def _(spark, d):
    e = sample.numbered(table(spark, d, "events").select("event_id", "user_id"), ["event_id"], "i")
    other = e.select("i", (F.col("user_id") + F.when(F.col("i") % 10 == 0, 1).otherwise(0)).alias("user_id"))
    return joins.zip_by_ordinal(e, other, "i", "user_id").select("i", "event_id", "aligned")


@query("join_alternatives", "J16", """
SELECT l_orderkey, l_linenumber, l_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN 2 ELSE 3 END, l_linenumber, l_partkey, l_suppkey) AS rn FROM lineitem WHERE l_discount < 0.05) WHERE rn = 1""")
def _(spark, d):
    prio = F.when(F.col("l_returnflag") == "R", 1).when(F.col("l_returnflag") == "A", 2).otherwise(3)
    return joins.keep_first(table(spark, d, "lineitem").where("l_discount < 0.05"), ["l_orderkey"], [prio, "l_linenumber", "l_partkey", "l_suppkey"]).select("l_orderkey", "l_linenumber", "l_suppkey")


@query("join_diff", "J17 M07 K04", """
SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 1 THEN 'added' WHEN o_orderkey % 10 = 2 THEN 'removed' ELSE 'changed' END AS change FROM orders WHERE o_orderkey % 10 IN (1, 2, 3)""")
def _(spark, d):
    o = table(spark, d, "orders")
    old = o.where("o_orderkey % 10 <> 1")
    new = o.where("o_orderkey % 10 <> 2").withColumn("o_totalprice", F.col("o_totalprice") + F.when(F.col("o_orderkey") % 10 == 3, 1.0).otherwise(0.0))
    return joins.row_diff(old, new, ["o_orderkey"])


@query("join_preservation", "J18 V12 V13", "SELECT 0::BIGINT AS lost, count(*) AS kept FROM customer")
def _(spark, d):
    old = table(spark, d, "customer")
    new = old.union(old.where("c_custkey % 2 = 0").withColumn("c_custkey", -F.col("c_custkey")))
    lost = old.exceptAll(new).agg(F.count("*").alias("lost"))
    return lost.crossJoin(old.agg(F.count("*").alias("kept")))  # one row by one row


@query("join_related", "J23", """
SELECT p_partkey, r_partkey FROM (SELECT a.p_partkey, b.p_partkey AS r_partkey, row_number() OVER (PARTITION BY a.p_partkey ORDER BY b.p_partkey) AS rn FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_type = b.p_type AND a.p_partkey <> b.p_partkey) WHERE rn <= 4""")
def _(spark, d):
    # the first five of a brand and type hold the first four others of every member
    p = table(spark, d, "part")
    w = W.partitionBy("p_brand", "p_type").orderBy("p_partkey")
    few = p.withColumn("rn", F.row_number().over(w)).where("rn <= 5").select("p_brand", "p_type", F.col("p_partkey").alias("r_partkey"))
    j = p.join(few, ["p_brand", "p_type"]).where("p_partkey <> r_partkey")
    return j.withColumn("rn", F.row_number().over(W.partitionBy("p_partkey").orderBy("r_partkey"))).where("rn <= 4").select("p_partkey", "r_partkey")


# aggregations
@query("agg_count", "A01 A27", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2")
def _(spark, d):
    return table(spark, d, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("agg_collect_set", "A03", "SELECT l_suppkey, count(DISTINCT l_returnflag) AS n, string_agg(DISTINCT l_returnflag, '' ORDER BY l_returnflag) AS flags FROM lineitem GROUP BY l_suppkey")
def _(spark, d):
    s = F.array_sort(F.collect_set("l_returnflag"))
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.size(s).cast("long").alias("n"), F.array_join(s, "").alias("flags"))


_HEADS = "猫", "爱好", "A", "电脑", "B超"
_AUDIT = r"""
WITH r AS (SELECT p_type AS trad, ['猫','爱好','A','电脑','B超'][p_partkey % 5 + 1] AS simp, p_size AS py, CASE p_partkey % 4 WHEN 0 THEN [p_name, 'CL:个'] WHEN 1 THEN [p_name, p_brand] WHEN 2 THEN ['CL:只'] ELSE [p_name || ' (idiom)', ''] END AS defs FROM part),
s AS (SELECT simp, py, unnest(list_filter(defs, lambda x: NOT regexp_matches(x, '(?i)^CL:'))) AS def FROM r)
SELECT (SELECT count(*) FROM r) AS "rows", (SELECT count(DISTINCT (trad, simp, py)) FROM r) AS unique_entries, (SELECT count(DISTINCT simp) FROM r) AS unique_headwords, (SELECT count(*) FROM s) AS sense_records,
  (SELECT CAST(sum(len(defs)) AS BIGINT) FROM r) AS raw_definitions, (SELECT CAST(sum(len(list_filter(defs, lambda x: regexp_matches(x, '(?i)^CL:')))) AS BIGINT) FROM r) AS classifier_only,
  (SELECT count(*) FROM r WHERE length(simp) = 1) AS single_entries, (SELECT count(DISTINCT simp) FROM r WHERE length(simp) = 1) AS single_characters,
  (SELECT count(*) FROM r WHERE regexp_matches(simp, '^\p{Han}$')) AS single_han_entries, (SELECT count(DISTINCT simp) FROM r WHERE regexp_matches(simp, '^\p{Han}$')) AS single_han_characters,
  (SELECT count(DISTINCT c) FROM (SELECT unnest(regexp_extract_all(trad || simp, '\p{Han}')) AS c FROM r)) AS han_characters, (SELECT count(*) FROM r WHERE length(simp) > 1) AS compound_entries,
  (SELECT count(*) FROM s WHERE regexp_matches(def, '\(idiom\)')) AS idiom_senses, (SELECT count(*) FROM s WHERE trim(def) <> '') AS english_nonempty,
  (SELECT count(*) FROM r WHERE len(list_filter(defs, lambda x: NOT regexp_matches(x, '(?i)^CL:'))) > 1) AS multiple_sense_entries"""


@query("agg_audit", "A04 A22", _AUDIT)
def _(spark, d):
    k = F.col("p_partkey")
    heads = F.array(*[F.lit(h) for h in _HEADS])
    defs = F.when(k % 4 == 0, F.array("p_name", F.lit("CL:个"))).when(k % 4 == 1, F.array("p_name", "p_brand")).when(k % 4 == 2, F.array(F.lit("CL:只"))).otherwise(F.array(F.concat("p_name", F.lit(" (idiom)")), F.lit("")))
    rows = table(spark, d, "part").select(F.col("p_type").alias("traditional"), F.element_at(heads, (k % 5 + 1).cast("int")).alias("simplified"), F.col("p_size").alias("pinyin"), defs.alias("definitions"))
    return corpus_audit(rows)


@query("agg_characters", "A05", "SELECT c, count(*) AS n FROM (SELECT unnest(string_split(p_name || p_type, '')) AS c FROM part) GROUP BY c")
def _(spark, d):
    return table(spark, d, "part").select(F.explode(F.filter(F.split(F.concat("p_name", "p_type"), ""), lambda x: x != "")).alias("c")).groupBy("c").agg(F.count("*").alias("n"))


@query("agg_coverage", "A06 A22", """
SELECT lang, count(*) AS n, round(100.0 * count(quality) / count(*), 4) AS pct_labelled, round(100.0 * count(*) FILTER (quality = 1) / count(*), 4) AS pct_good, count(*) FILTER (quality = 1) + count(*) FILTER (quality = 0) + count(*) FILTER (quality IS NULL) = count(*) AS balanced FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang""")
def _(spark, d):
    j = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    n, good, bad, none = F.count("*"), F.count_if(F.col("quality") == 1), F.count_if(F.col("quality") == 0), F.count_if(F.col("quality").isNull())
    return j.groupBy("lang").agg(n.alias("n"), F.round(F.count("quality") * 100.0 / n, 4).alias("pct_labelled"), F.round(good * 100.0 / n, 4).alias("pct_good"), (good + bad + none == n).alias("balanced"))


@query("agg_upper_median", "A10 A09", """
SELECT event_type, list_sort(list(value))[len(list(value)) // 2 + 1] AS upper_median, max(value) AS top, round(avg(value), 6) AS mean FROM events GROUP BY event_type""")
def _(spark, d):
    e = table(spark, d, "events").select("event_type", "value")
    told = e.groupBy("event_type").agg(F.max("value").alias("top"), F.round(F.avg("value"), 6).alias("mean"))
    mid = selection.select_rank(e, "event_type", "value", lambda n: F.floor(n / 2) + 1)
    return mid.select("event_type", F.col("value").alias("upper_median")).join(told, "event_type")


@query("agg_upper_medians_of_many", "A10", """
SELECT l_suppkey, count(*) AS n, list_sort(list(l_extendedprice))[(count(*) * 9 + 9) // 10] AS ninth_decile FROM lineitem GROUP BY l_suppkey""")
def _(spark, d):
    decile = selection.select_rank(table(spark, d, "lineitem"), "l_suppkey", "l_extendedprice", lambda n: F.ceil(n * 9 / 10))
    return decile.withColumnRenamed("l_extendedprice", "ninth_decile")


@query("agg_dominant", "A11", """
SELECT o_orderstatus, round(max(n) * 1.0 / sum(n), 6) AS dominant FROM (SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2) GROUP BY 1""")
def _(spark, d):
    c = table(spark, d, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))
    return c.groupBy("o_orderstatus").agg(F.round(F.max("n") / F.sum("n"), 6).alias("dominant"))


@query("agg_keep_first", "A12 A15 J21", """
SELECT k, doc_id FROM (SELECT sha256(lower(text)) AS k, doc_id, row_number() OVER (PARTITION BY lower(text) ORDER BY source, doc_id) AS rn FROM documents) WHERE rn = 1""")
def _(spark, d):
    rows = table(spark, d, "documents").select(F.sha2(F.lower("text"), 256).alias("k"), "doc_id", "source")
    return joins.keep_first(rows, ["k"], ["source", "doc_id"]).select("k", "doc_id")


@query("agg_exact_dedup_report", "A14 A17", """
SELECT count(*) AS n, count(*) - count(DISTINCT text) AS exact_saved, count(*) - count(DISTINCT (text, source)) AS strict_saved, count(*) - count(DISTINCT lower(regexp_replace(text, '[^A-Za-z]+', '', 'g'))) AS semantic_saved FROM documents""")
def _(spark, d):
    keys = table(spark, d, "documents").select(F.sha2("text", 256).alias("a"), F.sha2(F.concat_ws("\x00", "text", "source"), 256).alias("b"), F.sha2(F.lower(F.regexp_replace("text", "[^A-Za-z]+", "")), 256).alias("c"))
    return keys.agg(F.count("*").alias("n"), *[(F.count("*") - F.count_distinct(c)).alias(name) for c, name in (("a", "exact_saved"), ("b", "strict_saved"), ("c", "semantic_saved"))])


@query("agg_dictionary_encode", "A16 K03", """
SELECT s, n, row_number() OVER (ORDER BY s) - 1 AS id FROM (SELECT p_type AS s, count(*) AS n FROM part GROUP BY 1) WHERE n > 1 AND length(s) > 4""")
def _(spark, d):
    c = table(spark, d, "part").groupBy(F.col("p_type").alias("s")).agg(F.count("*").alias("n")).where("n > 1 and length(s) > 4")
    return sample.numbered(c, ["s"], "id").withColumn("id", F.col("id") - 1)


@query("agg_min_distance", "A18 A19", """
SELECT n_regionkey, min_by(n_name, abs(n_nationkey - 12) * 100 + n_nationkey) AS label, CASE WHEN min(CASE n_name WHEN 'CHINA' THEN 1 WHEN 'INDIA' THEN 2 ELSE 9 END) < 9 THEN 'priority' ELSE 'default' END AS category FROM nation GROUP BY 1""")
def _(spark, d):
    prio = F.min(F.when(F.col("n_name") == "CHINA", 1).when(F.col("n_name") == "INDIA", 2).otherwise(9))
    return table(spark, d, "nation").groupBy("n_regionkey").agg(F.min_by("n_name", F.struct(F.abs(F.col("n_nationkey") - 12), "n_nationkey")).alias("label"), F.when(prio < 9, "priority").otherwise("default").alias("category"))


@query("agg_buckets", "A20", "SELECT p_brand, string_agg(DISTINCT p_type, '|' ORDER BY p_type) AS types FROM part GROUP BY p_brand")
def _(spark, d):
    return table(spark, d, "part").groupBy("p_brand").agg(F.array_join(F.array_sort(F.collect_set("p_type")), "|").alias("types"))


@query("agg_digest", "A21 M08 F24", """
WITH a AS (SELECT o_orderkey // 1000 AS k, sha256(string_agg(o_orderkey || ':' || o_orderstatus || ':' || o_orderpriority, chr(10) ORDER BY o_orderkey)) AS s, count(*) AS n FROM orders GROUP BY 1),
b AS (SELECT k // 1000 AS k, sha256(string_agg(s, chr(10) ORDER BY k)) AS s, CAST(sum(n) AS BIGINT) AS n FROM a GROUP BY 1)
SELECT sha256(string_agg(s, chr(10) ORDER BY k)) AS digest, CAST(sum(n) AS BIGINT) AS rows_ FROM b""")
def _(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", F.concat_ws(":", F.col("o_orderkey").cast("string"), "o_orderstatus", "o_orderpriority").alias("line"))
    return joins.ordered_digest(orders, "o_orderkey", "line")


@query("agg_rate_gate", "A23 V09", """
WITH s AS (SELECT source, count(*) AS n, avg(quality) AS rate, sum(toxic) AS critical FROM documents JOIN labels USING (doc_id) GROUP BY source)
SELECT source, n, round(rate, 6) AS rate, array_to_string(list_filter([CASE WHEN n < 10 THEN 'few' END, CASE WHEN rate < 0.85 THEN 'rate' END, CASE WHEN critical > 0 THEN 'critical' END], lambda x: x IS NOT NULL), ',') AS blockers FROM s""")
def _(spark, d):
    from glossa.operators.quality import issues

    s = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").groupBy("source").agg(F.count("*").alias("n"), F.avg("quality").alias("rate"), F.sum("toxic").alias("critical"))
    found = issues({"few": F.col("n") < 10, "rate": F.col("rate") < 0.85, "critical": F.col("critical") > 0})
    return s.select("source", "n", F.round("rate", 6).alias("rate"), F.array_join(found, ",").alias("blockers"))


@query("agg_pivot", "A24 A25", """
SELECT o_orderpriority, count(*) AS before, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o, count(*) - count(*) FILTER (o_orderstatus IN ('F', 'O')) AS remaining FROM orders GROUP BY 1""")
def _(spark, d):
    s = F.col("o_orderstatus")
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("before"), F.count_if(s == "F").alias("f"), F.count_if(s == "O").alias("o"), (F.count("*") - F.count_if(s.isin("F", "O"))).alias("remaining"))


@query("agg_matrix", "A25", "SELECT lang, quality, count(*) AS n, count(*) FILTER (toxic = 1) AS matches FROM documents JOIN labels USING (doc_id) GROUP BY lang, quality")
def _(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").groupBy("lang", "quality").agg(F.count("*").alias("n"), F.count_if(F.col("toxic") == 1).alias("matches"))


@query("agg_rollup_extension", "A09", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def _(spark, d):
    return table(spark, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


# set operations
@query("set_union", "U01 U02 J21", "SELECT n_name AS term FROM nation UNION SELECT r_name FROM region")
def _(spark, d):
    return table(spark, d, "nation").select(F.col("n_name").alias("term")).union(table(spark, d, "region").select("r_name")).distinct()


@query("set_intersect", "U03", "SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9000 INTERSECT SELECT s_nationkey FROM supplier")
def _(spark, d):
    return table(spark, d, "customer").where("c_acctbal > 9000").select(F.col("c_nationkey").alias("k")).intersect(table(spark, d, "supplier").select("s_nationkey"))


@query("set_except_all", "U04", "SELECT o_custkey AS k FROM orders EXCEPT ALL SELECT c_custkey FROM customer")
def _(spark, d):
    return table(spark, d, "orders").select(F.col("o_custkey").alias("k")).exceptAll(table(spark, d, "customer").select("c_custkey"))


@query("set_jaccard", "U05", """
WITH w AS (SELECT p_partkey, list_distinct(string_split(p_name, ' ')) AS a, list_distinct(string_split(p_type || ' red', ' ')) AS b FROM part)
SELECT p_partkey, round(len(list_intersect(a, b)) * 1.0 / greatest(1, len(list_distinct(list_concat(a, b)))), 6) AS jaccard FROM w""")
def _(spark, d):
    a, b = F.split("p_name", " "), F.split(F.concat("p_type", F.lit(" red")), " ")
    return table(spark, d, "part").select("p_partkey", F.round(F.size(F.array_intersect(a, b)) / F.greatest(F.lit(1), F.size(F.array_union(a, b))), 6).alias("jaccard"))


@query("graph_components", "U07 G05", """
WITH RECURSIVE e AS (SELECT o_orderkey AS a, -o_custkey AS b FROM orders), b AS (SELECT a AS u, b AS v FROM e UNION SELECT b, a FROM e),
r AS (SELECT u AS node, u AS seen FROM b UNION SELECT r.node, b.v FROM r JOIN b ON r.seen = b.u) SELECT node, min(seen) AS component FROM r GROUP BY node""")
def _(spark, d):
    # an order and its customer are one identity; customers are negative
    e = table(spark, d, "orders").select(F.col("o_orderkey").alias("a"), (-F.col("o_custkey")).alias("b"))
    return graph.connected_components(e, "a", "b")


@query("graph_components_dense", "U07 G05")
def _(spark, d):
    # parts and suppliers of all lines: dense, so no SQL; random graphs are tested against brute force
    return graph.connected_components(table(spark, d, "lineitem").select("l_partkey", (-F.col("l_suppkey")).alias("b")), "l_partkey", "b")


@query("graph_closure", "G01 G06", """
WITH RECURSIVE e AS (SELECT DISTINCT p_partkey AS a, p_partkey // 2 AS b FROM part WHERE p_partkey > 1),
r AS (SELECT a, b, 1 AS n FROM e UNION ALL SELECT r.a, e.b, n + 1 FROM r JOIN e ON r.b = e.a) SELECT a AS src, b AS dst, min(n) AS distance FROM r GROUP BY 1, 2""")
def _(spark, d):
    e = table(spark, d, "part").where("p_partkey > 1").select("p_partkey", F.floor(F.col("p_partkey") / 2).alias("parent"))
    return graph.transitive_closure(e, "p_partkey", "parent")


_RULES = [("Brand#3", 2, "warm"), ("Brand#11", 1, "west"), ("Brand#20", 3, "old")]


@query("graph_category", "G02", """
WITH RECURSIVE e AS (SELECT p_partkey AS c, p_partkey * 2 // 3 AS p FROM part WHERE p_partkey > 0 UNION SELECT p_partkey, p_partkey // 5 FROM part WHERE p_partkey > 0 AND p_size % 3 = 0),
r(node, anc) AS (SELECT p_partkey, p_partkey FROM part UNION SELECT r.node, e.p FROM r JOIN e ON r.anc = e.c),
m AS (SELECT p_partkey AS node, p_brand AS mark FROM part WHERE p_size % 4 = 1 UNION ALL SELECT p_partkey, 'tiny' FROM part WHERE p_size = 2 AND p_partkey > 50),
rules(mark, prio, cat) AS (VALUES ('Brand#3', 2, 'warm'), ('Brand#11', 1, 'west'), ('Brand#20', 3, 'old')),
k AS (SELECT r.node, min_by(cat, prio) AS cat, bool_or(m.mark = 'tiny') AS barred FROM r JOIN m ON m.node = r.anc LEFT JOIN rules USING (mark) GROUP BY r.node)
SELECT p_partkey, coalesce(cat, CASE WHEN p_size > 40 THEN 'concept' END) AS category FROM part LEFT JOIN k ON node = p_partkey WHERE NOT coalesce(barred, false) AND coalesce(cat, CASE WHEN p_size > 40 THEN 'concept' END) IS NOT NULL""")
def _(spark, d):
    # a hierarchy of parts, some with two parents, deeper than ten steps from 60 parts on
    p = table(spark, d, "part")
    up = p.where("p_partkey > 0")
    edges = up.selectExpr("p_partkey as child", "p_partkey * 2 div 3 as parent").union(up.where("p_size % 3 = 0").selectExpr("p_partkey", "p_partkey div 5"))
    marks = p.where("p_size % 4 = 1").selectExpr("p_partkey as node", "p_brand as mark").union(p.where("p_size = 2 and p_partkey > 50").selectExpr("p_partkey", "'tiny'"))
    nodes = p.selectExpr("p_partkey as node", "case when p_size > 40 then 'concept' end as own")
    found = graph.categories(nodes, edges, marks, spark.createDataFrame(_RULES, "mark string, priority int, category string"), spark.createDataFrame([("tiny",)], "mark string"), "own")
    return found.withColumnRenamed("node", "p_partkey")


@query("graph_neighbourhood", "G03 A18", """
WITH e AS (SELECT p_partkey AS a, p_partkey // 2 AS b, p_size % 2 = 0 AS on_ FROM part WHERE p_partkey > 1 UNION ALL SELECT p_partkey // 2, p_partkey, p_size % 2 = 0 FROM part WHERE p_partkey > 1),
s0 AS (SELECT p_partkey AS node, min(p_brand) AS label FROM part WHERE p_size = 50 GROUP BY 1),
s1 AS (SELECT b AS node, min(label) AS label FROM s0 JOIN e ON node = a WHERE b NOT IN (SELECT node FROM s0) GROUP BY b),
s2 AS (SELECT b AS node, min(label) AS label FROM s1 JOIN e ON node = a AND on_ WHERE b NOT IN (SELECT node FROM s0 UNION ALL SELECT node FROM s1) GROUP BY b)
SELECT node, label, 0 AS distance FROM s0 UNION ALL SELECT node, label, 1 FROM s1 UNION ALL SELECT node, label, 2 FROM s2""")
def _(spark, d):
    p = table(spark, d, "part")
    up = p.where("p_partkey > 1").select("p_partkey", F.expr("p_partkey div 2").alias("parent"), (F.col("p_size") % 2 == 0).alias("even"))
    edges = up.union(up.select("parent", "p_partkey", "even"))
    return graph.neighbourhood(p.where("p_size = 50"), edges, "p_partkey", "p_brand", "p_partkey", "parent", 2, "even")


@query("join_preferred_row", "X15 A12 P02", """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY CASE WHEN regexp_matches(p_name, 'steel') THEN 0 WHEN NOT regexp_matches(p_name, 'red|tin') THEN 1 ELSE 2 END, p_partkey) AS rn FROM part)
SELECT p_brand, p_partkey, CASE WHEN p_size % 2 = 0 THEN 'curated' ELSE p_type END AS p_type, list_concat(list_filter(string_split(p_name, ' '), lambda w: length(w) = 3), list_filter(string_split(p_name, ' '), lambda w: length(w) <> 3)) AS senses FROM r WHERE rn = 1""")
def _(spark, d):
    # the collection's row of each headword: the first that a preference meets; then its senses in another order, and a field of its own
    p = table(spark, d, "part")
    best = joins.prefer(p, ["p_brand"], [F.col("p_name").rlike("steel"), ~F.col("p_name").rlike("red|tin")], ["p_partkey"])
    senses = F.split("p_name", " ")
    first = F.concat(F.filter(senses, lambda w: F.length(w) == 3), F.filter(senses, lambda w: F.length(w) != 3))
    return best.select("p_brand", "p_partkey", F.when(F.col("p_size") % 2 == 0, "curated").otherwise(F.col("p_type")).alias("p_type"), first.alias("senses"))


@query("graph_vocabulary", "G04", """
WITH v AS (SELECT DISTINCT unnest(string_split(lower(p_name), ' ')) AS tok FROM part WHERE p_partkey % 7 = 0), p AS (SELECT p_partkey, unnest(string_split(lower(p_name), ' ')) AS tok FROM part)
SELECT p_partkey FROM p LEFT JOIN v USING (tok) GROUP BY p_partkey HAVING count(*) = count(v.tok)""")
def _(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.explode(F.split(F.lower("p_name"), " ")).alias("tok"))
    v = p.where("p_partkey % 7 = 0").select("tok").distinct().withColumn("known", F.lit(1))
    return p.join(v, "tok", "left").groupBy("p_partkey").agg((F.count("*") == F.count("known")).alias("all")).where("all").select("p_partkey")
