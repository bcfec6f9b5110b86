"""Search over part and customer names."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glossa.functions import text as t
from glossa.operators import search as s
from glossa.plans.registry import query
from glossa.session import kept, table

_PQ = "(VALUES (1, 'red metal box'), (2, 'red'), (3, 'eel'), (4, 'blu'), (5, 'zzz'), (6, 'metal'))"
_QUERIES = [(1, "red metal box"), (2, "red"), (3, "eel"), (4, "blu"), (5, "zzz"), (6, "metal")]
_POSTS = "WITH q(qid, q) AS (SELECT * FROM (VALUES (1, 'red metal box'), (2, 'red'), (3, 'eel'), (4, 'blu'), (5, 'zzz'), (6, 'metal'))), p AS (SELECT DISTINCT p_partkey AS ord, unnest([lower(p_name), lower(p_type), lower(p_brand)]) AS key FROM part)"


def _index(spark, d):
    """The postings of part, built once for the table as it is and then read."""
    keys = [F.lower("p_name"), F.lower("p_type"), F.lower("p_brand")]
    return kept(spark, [f"{d}/part.parquet"], "part-keys", lambda: s.sorted_keys(s.postings(table(spark, d, "part"), "p_partkey", keys)))


def _grams(spark, d):
    return kept(spark, [f"{d}/part.parquet"], "part-grams", lambda: s.gram_rows(_index(spark, d)))


def _ask(spark):
    return spark.createDataFrame(_QUERIES, "qid int, q string")


@query("search_postings", "Q01 A26", """
WITH p AS (SELECT DISTINCT p_partkey AS ord, unnest([lower(p_name), lower(p_type), lower(p_brand)]) AS key FROM part), k AS (SELECT DISTINCT key FROM p)
SELECT (SELECT count(*) FROM k) AS terms, (SELECT count(DISTINCT w) FROM (SELECT unnest(string_split(key, ' ')) AS w FROM k)) AS tokens,
  (SELECT count(DISTINCT g) FROM (SELECT unnest(list_transform(range(1, length(key) - 1), lambda i: substring(key, i, 3))) AS g FROM k)) AS grams, (SELECT count(*) FROM p) AS postings, (SELECT CAST(sum(strlen(key)) AS BIGINT) FROM k) AS bytes""")
def _(spark, d):
    return s.statistics(_index(spark, d))


@query("search_exact", "Q02", _POSTS + " SELECT DISTINCT qid, ord FROM q JOIN p ON key = q")
def _(spark, d):
    return s.exact(_index(spark, d), _ask(spark))


@query("search_prefix", "Q03 J20", _POSTS + " SELECT DISTINCT qid, ord FROM q JOIN p ON starts_with(key, q)")
def _(spark, d):
    return s.prefix(_index(spark, d), _ask(spark))


@query("search_prefix_capped", "Q08 J20", _POSTS + ", h AS (SELECT qid, ord, dense_rank() OVER (PARTITION BY qid ORDER BY key) AS rk FROM q JOIN p ON starts_with(key, q)) SELECT DISTINCT qid, ord FROM h WHERE rk <= 3")
def _(spark, d):
    return s.prefix(_index(spark, d), _ask(spark), cap=3)


@query("search_substring", "Q04 W04", _POSTS + " SELECT DISTINCT qid, ord FROM q JOIN p ON contains(key, q) WHERE length(q) > 2")
def _(spark, d):
    return s.substring(_grams(spark, d), _ask(spark))


@query("search_phrase", "Q07 J19", _POSTS + " SELECT DISTINCT qid, ord FROM q JOIN p ON contains(key, q) AND key <> q AND list_has_all(string_split(key, ' '), string_split(q, ' '))")
def _(spark, d):
    return s.phrase(_index(spark, d), _ask(spark))


def _customers(spark, d):
    return s.postings(table(spark, d, "customer"), "c_custkey", [F.lower("c_name")])


def _near(spark, d):
    return kept(spark, [f"{d}/customer.parquet"], "customer-edits", lambda: s.near_rows(_customers(spark, d)))


@query("search_fuzzy", "Q09 F06", """
WITH q(qid, q) AS (VALUES (1, 'customer#000000012'), (2, 'customer#00000021'), (3, 'custmoer#000000007')), p AS (SELECT c_custkey AS ord, lower(c_name) AS key FROM customer)
SELECT qid, ord FROM q JOIN p ON damerau_levenshtein(q, key) = 1""")
def _(spark, d):
    q = spark.createDataFrame([(1, "customer#000000012"), (2, "customer#00000021"), (3, "custmoer#000000007")], "qid int, q string")
    return s.fuzzy(_near(spark, d), _customers(spark, d), q)


@query("search_fuzzy_all", "Q09 F06", """
WITH p AS (SELECT c_custkey AS ord, lower(c_name) AS key FROM customer) SELECT a.ord AS qid, b.ord FROM p a JOIN p b ON a.key <> b.key AND damerau_levenshtein(a.key, b.key) = 1""")
def _(spark, d):
    # every name asks for all names one edit away
    posts = _customers(spark, d)
    return s.fuzzy(_near(spark, d), posts, posts.select(F.col("ord").alias("qid"), F.col("key").alias("q")))


@query("search_shared_grams", "W03", """
WITH q(qid, q) AS (VALUES (1, 'customer#000000012'), (2, 'custmoer#000000007')), p AS (SELECT DISTINCT lower(c_name) AS key FROM customer),
g AS (SELECT key, unnest(list_distinct(list_transform(range(1, length(key) - 1), lambda i: substring(key, i, 3)))) AS gram FROM p),
a AS (SELECT qid, unnest(list_distinct(list_transform(range(1, length(q) - 1), lambda i: substring(q, i, 3)))) AS gram FROM q),
c AS (SELECT qid, key, count(*) AS shared FROM a JOIN g USING (gram) GROUP BY ALL)
SELECT qid, key, shared, CAST(row_number() OVER (PARTITION BY qid ORDER BY shared DESC, key) AS INTEGER) AS pos FROM c QUALIFY pos <= 256""")
def _(spark, d):
    return s.most_shared(_customers(spark, d), spark.createDataFrame([(1, "customer#000000012"), (2, "custmoer#000000007")], "qid int, q string"))


@query("search_topk", "Q02 Q03 Q04 W06 V15", _POSTS + """, h AS (SELECT qid, ord, CASE WHEN key = q THEN 0 WHEN starts_with(key, q) THEN 1 ELSE 2 END AS tier FROM q JOIN p ON starts_with(key, q) OR (length(q) > 2 AND contains(key, q))),
b AS (SELECT qid, ord, min(tier) AS tier FROM h GROUP BY 1, 2) SELECT qid, ord, tier, pos FROM (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY tier, ord) AS INTEGER) AS pos FROM b) WHERE pos <= 24""")
def _(spark, d):
    posts, q = _index(spark, d), _ask(spark)
    return s.tiered([s.exact(posts, q), s.prefix(posts, q), s.substring(_grams(spark, d), q)], 24)


@query("search_interleave", "W05 Q05", """
WITH a AS (SELECT p_size % 5 AS qid, p_partkey AS id, p_size % 7 = 0 AS exact, row_number() OVER (PARTITION BY p_size % 5 ORDER BY p_size % 7 = 0 DESC, p_partkey) AS rank FROM part), b AS (SELECT * FROM (SELECT p_size % 5 AS qid, p_partkey AS id, row_number() OVER (PARTITION BY p_size % 5 ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part) WHERE rank <= 7),
n AS (SELECT qid, count(*) AS n2 FROM b GROUP BY 1), r AS (SELECT a.qid, id, CASE WHEN a.qid IN (1, 3) AND NOT exact THEN 3 WHEN rank <= greatest(1, 24 - least(n2, 12)) THEN 0 ELSE 2 END AS band, rank FROM a JOIN n ON a.qid = n.qid UNION ALL SELECT qid, id, 1, rank FROM b),
m AS (SELECT qid, id, min(band * 100000000 + rank) AS place FROM r GROUP BY 1, 2) SELECT qid, id, pos FROM (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY place, id) AS INTEGER) AS pos FROM m) WHERE pos <= 24""")
def _(spark, d):
    p = table(spark, d, "part").select((F.col("p_size") % 5).alias("qid"), F.col("p_partkey").alias("id"), (F.col("p_size") % 7 == 0).alias("exact"), "p_retailprice")
    # no more than the limit and the second list's length can come from the first
    a = p.select("qid", "id", "exact", F.row_number().over(W.partitionBy("qid").orderBy(F.desc("exact"), "id")).alias("rank")).where("rank <= 24 + 7")
    b = p.select("qid", "id", F.row_number().over(W.partitionBy("qid").orderBy(F.desc("p_retailprice"), "id")).alias("rank")).where("rank <= 7")
    return s.interleave(a, b, 24, spark.createDataFrame([(1,), (3,)], "qid int"))


@query("search_ranked_groups", "Q06 W01", """
WITH g AS (SELECT l_partkey AS word, lower(l_returnflag) AS key, 0 AS rank, l_discount AS conf FROM lineitem UNION ALL SELECT l_partkey, lower(l_linestatus), 1, l_tax FROM lineitem)
SELECT word, key, rank, conf FROM (SELECT *, row_number() OVER (PARTITION BY word, key ORDER BY rank, conf DESC) AS rn FROM g) WHERE rn = 1""")
def _(spark, d):
    line = table(spark, d, "lineitem")
    g = line.select(F.col("l_partkey").alias("word"), F.lower("l_returnflag").alias("key"), F.lit(0).alias("rank"), F.col("l_discount").alias("conf")).union(line.select("l_partkey", F.lower("l_linestatus"), F.lit(1), "l_tax"))
    best = g.groupBy("word", "key").agg(F.min_by(F.struct("rank", "conf"), F.struct("rank", -F.col("conf"))).alias("b"))
    return best.select("word", "key", "b.rank", "b.conf")


@query("search_five_keys", "W02 J19", """
SELECT p_partkey, pos FROM (SELECT p_partkey, row_number() OVER (ORDER BY p_size, p_retailprice DESC, p_brand = 'Brand#1' DESC, length(p_name), p_partkey) AS pos FROM part) WHERE pos <= 24""")
def _(spark, d):
    top = table(spark, d, "part").orderBy("p_size", F.desc("p_retailprice"), F.desc(F.col("p_brand") == "Brand#1"), F.length("p_name"), "p_partkey").limit(24)
    w = W.orderBy("p_size", F.desc("p_retailprice"), F.desc(F.col("p_brand") == "Brand#1"), F.length("p_name"), "p_partkey")
    return top.select("p_partkey", F.row_number().over(w).cast("long").alias("pos"))


@query("search_core_first", "Q11 Q13 J21", """
WITH core AS (SELECT n_nationkey AS id, n_name AS name FROM nation WHERE n_regionkey = 0), q(q) AS (VALUES ('ALGERIA'), ('CHINA'), ('KENYA')), full_ AS (SELECT n_nationkey AS id, n_name AS name FROM nation)
SELECT q, id, 'core' AS side FROM q JOIN core ON name = q UNION ALL SELECT q, id, 'full' FROM q JOIN full_ ON name = q WHERE q NOT IN (SELECT name FROM core)""")
def _(spark, d):
    n = table(spark, d, "nation")
    q = spark.createDataFrame([("ALGERIA",), ("CHINA",), ("KENYA",)], "q string")
    core = q.join(n.where("n_regionkey = 0"), F.col("n_name") == F.col("q")).select("q", F.col("n_nationkey").alias("id"), F.lit("core").alias("side"))
    rest = q.join(core, "q", "left_anti").join(n, F.col("n_name") == F.col("q")).select("q", F.col("n_nationkey").alias("id"), F.lit("full").alias("side"))
    return core.union(rest)


@query("search_shaped", "Q10", """
WITH h AS (SELECT p_partkey AS ord, p_size % 4 AS qid, lower(p_brand) AS key FROM part), s AS (SELECT p_partkey AS ord, 'sense-' || i AS sense, lower(CASE i WHEN 0 THEN p_type WHEN 1 THEN p_brand ELSE p_brand END) AS key FROM part, (VALUES (0), (1), (2)) v(i) WHERE p_partkey % 3 > 0)
SELECT h.ord, h.key, h.qid, min(sense) AS matched_sense, 'malay' AS matched_language FROM h LEFT JOIN s ON h.ord = s.ord AND h.key = s.key GROUP BY 1, 2, 3""")
def _(spark, d):
    p = table(spark, d, "part")
    hits = p.select(F.col("p_partkey").alias("ord"), (F.col("p_size") % 4).alias("qid"), F.lower("p_brand").alias("key"))
    senses = p.where("p_partkey % 3 > 0").select(F.col("p_partkey").alias("ord"), F.posexplode(F.array(F.lower("p_type"), F.lower("p_brand"), F.lower("p_brand"))).alias("i", "key"))
    return s.shaped(hits, senses.select("ord", "key", F.concat(F.lit("sense-"), F.col("i").cast("string")).alias("sense")), "malay")


@query("search_early_exact", "Q12", """
WITH q(qid, q) AS (VALUES (1, '猫'), (2, '电脑'), (3, 'cat'), (4, '猫a'), (5, '貓')), e AS (SELECT p_partkey AS id, ['猫', '电脑', '狗'][p_partkey % 3 + 1] AS simp, ['貓', '電腦', '狗'][p_partkey % 3 + 1] AS trad, p_partkey % 10 > 7 AS late FROM part)
SELECT qid, id, pos FROM (SELECT qid, id, CAST(row_number() OVER (PARTITION BY qid ORDER BY late, id) AS INTEGER) AS pos FROM q JOIN e ON q = simp OR q = trad WHERE regexp_matches(q, '^\\p{Han}+$')) WHERE pos <= 24""")
def _(spark, d):
    k = (F.col("p_partkey") % 3 + 1).cast("int")
    words = lambda *w: F.element_at(F.array(*[F.lit(x) for x in w]), k)
    e = table(spark, d, "part").select(F.col("p_partkey").alias("id"), words("猫", "电脑", "狗").alias("simplified"), words("貓", "電腦", "狗").alias("traditional"))
    q = spark.createDataFrame([(1, "猫"), (2, "电脑"), (3, "cat"), (4, "猫a"), (5, " 貓 ")], "qid int, q string")
    return s.early_exact(q, e.where("id % 10 <= 7"), e.where("id % 10 > 7"))


@query("search_self_check", "Q14 V15", "SELECT count(DISTINCT p_partkey) AS documents, 0::BIGINT AS lost FROM part")
def _(spark, d):
    posts = _index(spark, d)
    found = s.exact(posts, posts.select(F.col("ord").alias("qid"), F.col("key").alias("q")))
    lost = posts.select(F.col("ord").alias("qid"), "ord").join(found, ["qid", "ord"], "left_anti")
    return posts.agg(F.count_distinct("ord").alias("documents")).crossJoin(lost.agg(F.count("*").alias("lost")))  # single rows


@query("search_containment", "J19 P11", """
WITH w AS (SELECT doc_id, unnest(list_distinct(string_split(lower(text), ' '))) AS word FROM documents), b AS (SELECT item_id, unnest(list_distinct(string_split(lower(text), ' '))) AS word FROM benchmark), n AS (SELECT item_id, count(*) AS n FROM b GROUP BY 1)
SELECT item_id, doc_id, count(*) AS shared FROM b JOIN w USING (word) JOIN n USING (item_id) WHERE length(word) > 6 GROUP BY item_id, doc_id, n HAVING count(*) * 3 >= n""")
def _(spark, d):
    w = table(spark, d, "documents").select("doc_id", F.explode(F.array_distinct(F.split(F.lower("text"), " "))).alias("word"))
    b = table(spark, d, "benchmark").select("item_id", F.explode(F.array_distinct(F.split(F.lower("text"), " "))).alias("word"))
    n = b.groupBy("item_id").agg(F.count("*").alias("n"))
    hits = b.where(F.length("word") > 6).join(w.where(F.length("word") > 6), "word").groupBy("item_id", "doc_id").agg(F.count("*").alias("shared"))
    return hits.join(n, "item_id").where(F.col("shared") * 3 >= F.col("n")).select("item_id", "doc_id", "shared")
