"""Classification, ranking and inference queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from glossa.functions import text as t
from glossa.functions import urls as u
from glossa.operators import classify, inference, packs, rank
from glossa.plans.registry import query
from glossa.session import table


@query("rank_relevance", "X13 X10", """
WITH p AS (SELECT p_partkey, list_distinct(string_split(lower(p_name || ' ' || p_type), ' ')) AS ts, p_partkey % 7 AS prio FROM part),
m AS (SELECT p_partkey, prio, len(list_intersect(ts, ['red', 'blue'])) AS a, len(list_intersect(ts, ['steel', 'tin'])) AS b, len(list_intersect(ts, ['box', 'metal'])) AS c FROM p)
SELECT p_partkey, CAST(CASE WHEN a + b + c = 0 THEN -1 ELSE CASE WHEN a > 0 THEN 300 WHEN b > 0 THEN 200 ELSE 30 END + 3 * least(9, a + b + c) + greatest(0, 5 - prio) - CASE WHEN p_partkey % 2 = 0 THEN 35 ELSE 0 END END AS BIGINT) AS score FROM m""")
def _(spark, d):
    tokens = F.array_distinct(F.split(F.lower(F.concat_ws(" ", "p_name", "p_type")), " "))
    words = [F.array(*[F.lit(w) for w in ws]) for ws in (("red", "blue"), ("steel", "tin"), ("box", "metal"))]
    score = rank.relevance(tokens, *words, F.col("p_partkey") % 7, F.col("p_partkey") % 2 == 0)
    return table(spark, d, "part").select("p_partkey", score.cast("long").alias("score"))


@query("rank_comparator", "W23 F22", """
SELECT page_id, pos FROM (SELECT page_id, CAST(row_number() OVER (ORDER BY page_id % 5 DESC, length(html) DESC, url, page_id) AS INTEGER) AS pos FROM pages) WHERE pos <= 50""")
def _(spark, d):
    from pyspark.sql import Window as W

    order = [F.desc(F.col("page_id") % 5), F.desc(F.length("html")), F.col("url"), F.col("page_id")]
    top = table(spark, d, "pages").select("page_id", "html", "url").orderBy(*order).limit(50)
    return top.select("page_id", F.row_number().over(W.orderBy(*order)).alias("pos"))


@query("rank_facets", "X11 X12 A27", """
WITH f AS (SELECT doc_id, list_filter([CASE WHEN regexp_matches(lower(text), '\\b(the|and)\\b') THEN 'english' END, CASE WHEN regexp_matches(lower(text), '\\b(der|und)\\b') THEN 'german' END, CASE WHEN contains(text, '|') THEN 'table' END], lambda x: x IS NOT NULL) AS fs FROM documents)
SELECT facet, count(*) AS n FROM (SELECT unnest(fs) AS facet FROM f) GROUP BY facet""")
def _(spark, d):
    docs = table(spark, d, "documents")
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"([a-z0-9_]+|\|)"), F.lit(1))
    return docs.select(F.explode(rank.facets(words, {"english": ["the", "and"], "german": ["der", "und"], "table": ["|"]})).alias("facet")).groupBy("facet").agg(F.count("*").alias("n"))


@query("rank_diverse", "W20 X12")
def _(spark, d):
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{4,})"), F.lit(1)))
    docs = table(spark, d, "documents").select("source", "doc_id", (F.col("n_chars") % 100).cast("double").alias("score"), words.alias("terms"), "text")
    docs = docs.withColumn("facets", F.array_compact(F.array(F.when(F.contains("text", F.lit("|")), F.lit("symbol")), *[F.when(F.contains("text", F.lit(c)), F.lit(c)) for c in "jqxyz"])))
    return rank.diverse_top(docs, "source", "doc_id", "score", "facets", "terms", 10, F.contains("text", F.lit("|")), F.contains("text", F.lit("man")), {"q": 2.0, "x": 0.5}, True)


_OVER = """f AS (SELECT source, doc_id, list_filter(['j', 'k', 'q', 'v', 'w', 'x', 'y', 'z', '0', '7', '|', '@'], lambda c: contains(text, c)) AS f, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS j, count(*) OVER (PARTITION BY source) AS n FROM documents)"""


def _over(pos: int, seen: str, taken: str, join: str) -> str:
    return f"""SELECT source, doc_id, f, j FROM (SELECT f.*, row_number() OVER (PARTITION BY f.source ORDER BY len(f.f) - len(list_intersect(f.f, {seen})) DESC, abs(f.j - CAST(floor({pos}.5 * n / least(3, n)) AS BIGINT)), f.j) AS rn FROM f {join}
      WHERE {pos} < least(3, n) AND {taken}) WHERE rn = 1"""


@query("rank_overview", "W21", f"""
WITH {_OVER}, a AS ({_over(0, "[]::VARCHAR[]", "true", "")}),
b AS ({_over(1, "a.f", "f.j <> a.j", "JOIN a ON f.source = a.source")}),
c AS ({_over(2, "list_concat(a.f, b.f)", "f.j <> a.j AND f.j <> b.j", "JOIN a ON f.source = a.source JOIN b ON f.source = b.source")})
SELECT source, 1 AS pos, doc_id FROM a UNION ALL SELECT source, 2, doc_id FROM b UNION ALL SELECT source, 3, doc_id FROM c""")
def _(spark, d):
    shown = F.array_compact(F.array(*[F.when(F.contains("text", F.lit(c)), F.lit(c)) for c in "jkqvwxyz07|@"]))
    return rank.overview(table(spark, d, "documents").select("source", "doc_id", shown.alias("facets")), "source", "doc_id", "facets")


@query("rank_stop_test", "W22 T08", """
SELECT lang, count(*) >= 20 AND count(DISTINCT source) FILTER (source <> 'src0') >= 2 AND count(*) FILTER (source = 'src1') > 0 AS enough FROM documents GROUP BY lang""")
def _(spark, d):
    docs = table(spark, d, "documents").select("lang", F.array(F.when(F.col("source") == "src0", "subject").otherwise(F.col("source"))).alias("f"))
    return docs.groupBy("lang").agg(rank.enough(F.col("f"), "src1", 20).alias("enough"))


#: Categories of nouns, and verbs, as a packed lexicon.
_LEXICON = [("animal", "dog|tiger|fish"), ("food", "bread|rice"), ("building", "house"), ("concept:act", "running"), ("person", "teacher"), ("verb", "run|eat|write|swim|see|think|attack|listen|read")]
#: A gloss, its part of speech, and the rule, kind, query, fallback and domain that it gives; no rule: no picture.
_GLOSSES = (
    ("to be very happy", None, "state", "emotion", "happy smiling person", "happy person", None), ("over the moon", None, "state", "emotion", "happy smiling person", "happy person", None),
    ("(fig.) lonely", "adj", "state", "emotion", "lonely person sitting", "lonely person", None), ("feeling sleepy; drowsy", None, "state", "human-state", "sleepy person yawning", "sleepy person", None),
    ("science and technology", "noun", "domain", "conceptual", "technology computers innovation", "science and technology", "technology"), ("to collaborate", "verb", "domain", "conceptual", "cooperation people teamwork", "collaborate", "cooperation"),
    ("to eat (food)", "verb", "action", "action", "person eating food", "person eating", None), ("running", None, "concept", "conceptual", "running concept", "running", "act"), ("to run away", "verb", "action", "action", "person running away", "person running away", None),
    ("writing a letter", None, "action", "action", "person writing", "person writing", None), ("to see", "verb", "action", "action", "person looking at scenery", "person looking", None),
    ("burst into tears", None, "action", "action", "person crying", "person crying", None), ("to think", "verb", "concept-verb", "conceptual", "think concept", "think", "general"), ("to attack", "verb", None, None, None, None, None),
    ("red", "adj", "colour", "property", "red color objects", "red", None), ("a tiger", "noun", "noun", "animal", "tiger animal", "tiger", None), ("big old houses", "noun", "noun", "building", "big old houses building", "big old houses", None),
    ("teacher (CL:個)", "noun", "noun", "person", "teacher person", "teacher", None), ("house of cards", "noun", "concept", "conceptual", "house of cards concept", "house of cards", "general"),
    ("umbrella", None, "concept", "conceptual", "umbrella concept", "umbrella", "general"), ("see also flag", None, None, None, None, None, None), ("variant of flag", None, None, None, None, None, None),
    ("surname Li", None, None, None, None, None, None), ("because of this", None, None, None, None, None, None), ("perhaps", None, None, None, None, None, None), ("de (modal particle)", None, None, None, None, None, None),
    ("and so", "conjunction", None, None, None, None, None), ("", None, None, None, None, None, None), ("旗", None, None, None, None, None, None),
    *((word, None, "state", kind, query, fallback, None) for kind, query, fallback, words in packs.FAMILIES.values() for word in words),
    *((word, None, "domain", "conceptual", query, word, name) for name, (query, words) in packs.DOMAINS.items() for word in words),
)


def _sql(x) -> str:
    return "NULL" if x is None else "'" + x.replace("'", "''") + "'"


_GLOSS_SQL = "(VALUES " + ", ".join(f"({i}, {', '.join(_sql(x) for x in g[2:])})" for i, g in enumerate(_GLOSSES)) + ") v(i, rule, kind, query, fallback, domain)"


def _glosses(spark, d):
    cases = spark.createDataFrame([(i, *g[:2]) for i, g in enumerate(_GLOSSES)], "i long, meaning string, pos string")
    packed = spark.createDataFrame(_LEXICON, "category string, words string")
    rows = table(spark, d, "part").select("p_partkey", (F.col("p_partkey") % len(_GLOSSES)).alias("i")).join(F.broadcast(cases), "i")  # a table of fixed size
    return rows.crossJoin(classify.lexicon(packed, "category", "words"))  # one row


@query("classify_rules", "X05 X06 X07 X16 X19", f"SELECT p_partkey, rule, kind, query, fallback, domain FROM part JOIN {_GLOSS_SQL} ON p_partkey % {len(_GLOSSES)} = i")
def _(spark, d):
    c = classify.classify(_glosses(spark, d), F.col("meaning"), F.col("pos"), F.col("verbs"), F.col("nouns"))
    return c.select("p_partkey", *[F.col(f"plan.{n}").alias(n) for n in ("rule", "kind", "query", "fallback", "domain")])


@query("classify_diagnose", "X14 X03", f"""
SELECT p_partkey, CASE WHEN rule IS NULL THEN 'none' ELSE rule END AS rule, i IN (20, 21) AS metadata, CASE WHEN i IN (0, 1) THEN 'state' END AS first_met FROM part JOIN {_GLOSS_SQL} ON p_partkey % {len(_GLOSSES)} = i""")
def _(spark, d):
    c = classify.classify(_glosses(spark, d), F.col("meaning"), F.col("pos"), F.col("verbs"), F.col("nouns"))
    return c.select("p_partkey", F.coalesce("plan.rule", F.lit("none")).alias("rule"), F.coalesce(F.col("excluded") == "metadata", F.lit(False)).alias("metadata"), F.when(F.col("i") <= 1, F.get("met", F.lit(0))).alias("first_met"))


@query("classify_documents", "X05 X14 A07")
def _(spark, d):
    # what every line of every document shows; the rules are compared with SQL by classify_rules
    lines = table(spark, d, "documents").select(F.explode(F.split("text", "\n")).alias("line"))
    c = classify.classify(lines, F.col("line"))
    return c.groupBy(F.coalesce("plan.rule", F.lit("none")).alias("rule"), F.col("plan.kind").alias("kind")).agg(F.count("*").alias("n"))


@query("classify_plan", "X10", "SELECT n_nationkey, tier, q FROM (SELECT n_nationkey, 'A' AS tier, 'flag of ' || lower(n_name) AS q FROM nation UNION ALL SELECT n_nationkey, 'B', lower(n_name) || ' place' FROM nation UNION ALL SELECT n_nationkey, 'C', lower(n_name) FROM nation)")
def _(spark, d):
    plan = classify.search_plan(F.lit("place"), F.concat(F.lit("flag of "), F.lower("n_name")), F.lower("n_name"))
    return table(spark, d, "nation").select("n_nationkey", F.inline(plan))


@query("identity_dedup", "F21 U07 P13", """
WITH k AS (SELECT page_id, regexp_replace(regexp_extract(url, '^https?://([^/?#]+)', 1), '^www\\.', '') || regexp_replace(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), '/$', '') AS page FROM pages) SELECT page_id, min(page_id) OVER (PARTITION BY page) AS identity FROM k""")
def _(spark, d):
    from glossa.operators import graph

    p = table(spark, d, "pages").withColumn("url", F.regexp_replace("url", r"\?.*$", ""))
    keys = p.select("page_id", F.explode(u.identity_keys(F.col("page_id"), F.col("url"))).alias("key")).where(F.col("key").startswith("page:"))
    first = keys.groupBy("key").agg(F.min("page_id").alias("first"))
    c = graph.connected_components(keys.join(first, "key").select("page_id", "first"), "page_id", "first")
    return c.select(F.col("node").alias("page_id"), F.col("component").alias("identity"))


@query("infer_memoised", "T11 T12 X01 A17", """
SELECT doc_id, CASE WHEN lang = 'de' THEN NULL ELSE upper(lang) END AS output, lang = 'de' AS failed, doc_id <> min(doc_id) OVER (PARTITION BY lang) AS reused FROM documents""")
def _(spark, d):
    @inference.adapter("upper")
    def run(batch: list[str]) -> list[str]:
        if "de" in batch:
            raise ValueError("not supported")
        return [x.upper() for x in batch]

    out = inference.infer(table(spark, d, "documents").select("doc_id", "lang"), "doc_id", "lang", run, tries=1)
    return out.select("doc_id", "output", F.col("error").isNotNull().alias("failed"), "reused")


@query("infer_retried", "T15 T13 T16", """
SELECT doc_id, CASE WHEN lang = 'de' THEN NULL ELSE upper(lang) END AS output, CASE WHEN lang = 'de' THEN 3 ELSE 1 END AS tries FROM documents""")
def _(spark, d):
    def run(batch: list[str]) -> list[str]:
        if "de" in batch:
            raise ValueError("not supported")
        return [x.upper() for x in batch]

    # so little memory that every batch is one of eight rows at most
    out = inference.infer(table(spark, d, "documents").select("doc_id", "lang"), "doc_id", "lang", run, pause=0.001, memory=lambda: 1, concurrency=4)
    return out.select("doc_id", "output", F.when(F.col("error").isNotNull(), F.col("tries")).otherwise(1).alias("tries"))


@query("infer_observed", "X04", """
SELECT count(*) AS rows, count(*) FILTER (lang = 'de') AS failed, count(*) - count(DISTINCT lang) AS reused FROM documents""")
def _(spark, d):
    from glossa.session import cut

    def run(batch: list[str]) -> list[str]:
        if "de" in batch:
            raise inference.PolicyError("barred") if len(batch) == 1 else ValueError("split it")
        return batch

    results, seen = inference.observed(inference.infer(table(spark, d, "documents").select("doc_id", "lang"), "doc_id", "lang", run, tries=1), "documents")
    cut(results)
    return spark.createDataFrame([(seen.get["rows"], seen.get["failed"], seen.get["reused"])], "rows long, failed long, reused long")


@query("qualify_terms", "X02 J09 J14", """
SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN 'bidal ' || lower(p_brand) WHEN p_size % 5 = 0 OR p_partkey % 7 = 1 THEN NULL WHEN p_size % 3 = 0 AND p_partkey % 7 <> 2 THEN 'Kata ' || p_size END AS malay,
  CASE WHEN p_partkey % 7 = 0 THEN NULL WHEN p_size % 5 = 0 OR p_partkey % 7 = 1 THEN 'linguistic-assessment-rejected' WHEN p_size % 3 <> 0 THEN 'no-qualified-exact-sense-term' WHEN p_partkey % 7 = 2 THEN 'qualified-term-not-in-concordant-synset' END AS reason FROM part""")
def _(spark, d):
    from glossa.operators import qualify

    senses = table(spark, d, "part").select("p_partkey", "p_brand", "p_size", F.col("p_partkey").cast("string").alias("headword"), F.concat(F.lit("size "), F.col("p_size").cast("string")).alias("english"))
    k = F.col("p_partkey") % 7
    sizes = senses.select("english", "p_size").distinct()
    terms = sizes.where("p_size % 3 = 0").select("english", F.concat(F.lit("Kata "), F.col("p_size").cast("string")).alias("malay"))
    idioms = senses.where(k == 0).select("headword", "english", F.concat(F.lit("bidal "), F.lower("p_brand")).alias("malay"))
    bad = sizes.where("p_size % 5 = 0").select(F.lit(None).cast("string").alias("headword"), "english").union(senses.where(k == 1).select("headword", "english"))
    both = senses.where(k != 2).select("headword", "english", F.concat(F.lit("KATA-"), F.col("p_size").cast("string")).alias("malay"))
    return qualify.qualify_terms(senses, terms, idioms, bad, both).select("p_partkey", "malay", "reason")


@query("infer_rounds", "T08", "SELECT p_partkey FROM part WHERE p_partkey % 10 IN (1, 2)")
def _(spark, d):
    p = table(spark, d, "part").select("p_partkey")
    return inference.rounds(lambda k: p.where(F.col("p_partkey") % 10 == min(k + 1, 2)), "p_partkey", 10**9)


@query("vector_topk_extension", "X13", """
SELECT q.vec_id AS query_id, e.vec_id, CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_distance(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 9), e.vec_id) AS INTEGER) AS rank FROM embeddings q JOIN embeddings e ON q.vec_id <> e.vec_id WHERE q.vec_id < 3 QUALIFY rank <= 5""")
def _(spark, d):
    from pyspark.sql import Window as W

    e = table(spark, d, "embeddings")
    q = F.broadcast(e.where("vec_id < 3").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")))  # three fixed queries
    dist = F.sqrt(F.aggregate(F.zip_with("q", "embedding", lambda a, b: (a.cast("double") - b) * (a.cast("double") - b)), F.lit(0.0), lambda s, x: s + x))
    j = e.join(q, F.col("vec_id") != F.col("query_id")).withColumn("dist", F.round(dist, 9))
    return j.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("dist", "vec_id"))).where("rank <= 5").select("query_id", "vec_id", "rank")
