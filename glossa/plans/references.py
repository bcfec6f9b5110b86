"""Cross-references: between pages that link to headings, and in glosses that are nothing but a reference."""

from __future__ import annotations

from pyspark.sql import functions as F

from glossa.functions import references as r
from glossa.functions import text as t
from glossa.operators import references
from glossa.plans.registry import query
from glossa.session import table

_TERMS = r"trim(regexp_replace(strip_accents(lower({0})), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"
_HEAD = r"regexp_extract(html, '<title>([^<\s]*)', 1)"


def _pages(spark, d):
    """Pages as senses: the entry is the first word of the title, a sense a page; those with a plain address are answered: by their section, with their language as class."""
    p = table(spark, d, "pages")
    p = p.select("page_id", "html", t.norm_terms(F.regexp_extract("html", r"<title>([^<\s]*)", 1)).alias("ref"), F.regexp_extract("url", "^https?://[^/]+/([^/?#]*)", 1).alias("text"), F.regexp_extract("html", '<html lang="([^"]*)"', 1).alias("cls"), F.col("url").rlike("[?#]").alias("marked"))
    return p.withColumn("sense", F.col("page_id"))


@query("join_cross_reference", "J13", rf"""
WITH p AS (SELECT page_id, html, {_TERMS.format(_HEAD)} AS ref, regexp_extract(url, '^https?://[^/]+/([^/?#]*)', 1) AS t, regexp_extract(html, '<html lang="([^"]*)"', 1) AS c, NOT regexp_matches(url, '[?#]') AS told FROM pages),
m AS (SELECT page_id, unnest(hs) AS h, generate_subscripts(hs, 1) - 1 AS nth FROM (SELECT page_id, regexp_extract_all(html, 'href="/([^"]*)"', 1) AS hs FROM p)),
e AS (SELECT ref, count(*) AS senses, count(*) FILTER (told) AS resolved, count(DISTINCT {_TERMS.format('t')}) = 1 AND count(DISTINCT c) = 1 AS agree, min_by(t, page_id) AS t, min(c) AS c FROM p GROUP BY ref),
j AS (SELECT page_id, nth, {_TERMS.format('h')} AS ref FROM m)
SELECT j.page_id, j.nth, j.ref, coalesce(senses, 0) AS senses, coalesce(resolved, 0) AS resolved,
  CASE WHEN senses = resolved AND agree THEN t END AS text, CASE WHEN senses = resolved AND agree THEN c END AS cls,
  CASE WHEN senses IS NULL THEN 'exact-target-script-or-pinyin-unavailable' WHEN resolved < senses THEN 'target-has-unresolved-senses' WHEN NOT agree THEN 'target-has-conflicting-senses-or-pos' END AS reason
FROM j LEFT JOIN e ON e.ref = j.ref""")
def _(spark, d):
    p = _pages(spark, d)
    links = F.transform(F.regexp_extract_all("html", F.lit('href="/([^"]*)"'), F.lit(1)), lambda h: F.struct(F.lit("variant").alias("kind"), t.norm_terms(h).alias("ref")))
    found = references.mentions(p, "page_id", links)
    return references.resolve(found, p.select("ref", "sense"), p.where(~F.col("marked")).select("sense", "text", "cls")).drop("kind").withColumn("nth", F.col("nth").cast("long"))


_LEADS = ("old variant of ", "erhua variant of ", "variant of ", "erhua form of ", "abbr. for ", "see ", "also written ", "form of ", "")
_SAID = ("Bentuk lama bagi X", "varian erhua X.", "bentuk lain daripada X", "Bentuk erhua x", "• Singkatan untuk X", "lihat X", "ditulis juga sebagai X", "X", "varian X")


def _gloss(name):
    """A gloss that refers, or nearly does, made of a part's key, and what a model might give for it."""
    k = F.col("p_partkey") % len(_LEADS)
    at = lambda vs: F.element_at(F.array(*[F.lit(v) for v in vs]), (k + 1).cast("int"))
    ref = F.concat(F.when(F.col("p_size") % 5 == 0, "").otherwise("字"), F.col("p_partkey").cast("string"), F.when(F.col("p_size") % 7 == 0, " ").otherwise(""), F.lit("[zi4]"))
    return F.concat(at(_LEADS), ref) if name == "gloss" else at(_SAID)


_LIST = lambda vs: "[" + ", ".join("'" + v + "'" for v in vs) + "]"


@query("text_reference_templates", "F26 F27", rf"""
WITH p AS (SELECT p_partkey, p_partkey % {len(_LEADS)} AS k, p_size % 5 <> 0 AND p_size % 7 <> 0 AS whole, '字' || p_partkey || '[zi4]' AS ref, ({_LIST(_SAID)})[p_partkey % {len(_LEADS)} + 1] AS said FROM part),
x AS (SELECT *, whole AND k < 7 AS refers, ({_LIST(('old-variant', 'erhua-variant', 'variant', 'erhua-form', 'abbreviation', 'see', 'also-written'))})[k + 1] AS kind,
  ({_LIST(('Varian lama', 'Varian erhua', 'Varian', 'Bentuk erhua', 'Singkatan', 'Lihat', 'Juga ditulis'))})[k + 1] || CASE WHEN k < 5 THEN ' bagi ' ELSE ' ' END AS lead FROM p)
SELECT p_partkey, CASE WHEN refers THEN kind END AS kind, CASE WHEN refers THEN ref END AS reference, CASE WHEN refers THEN lead || ref || '.' END AS definition,
  CASE WHEN refers THEN ({_LIST(('old written form of X', 'erhua variant of X', 'alternative written form of X', 'erhua form of X', 'abbreviation for X', 'see X', 'also written as X'))})[k + 1] END AS asked FROM x""")
def _(spark, d):
    p = table(spark, d, "part").select("p_partkey", _gloss("gloss").alias("gloss"), _gloss("said").alias("said")).withColumn("of", r.source(F.col("gloss")))
    p = p.withColumn("asked", r.protected_input(F.col("of.kind")))
    back = r.restore(F.col("gloss"), F.col("said"), F.col("asked"))
    return p.select("p_partkey", F.col("of.kind").alias("kind"), F.col("of.reference").alias("reference"), back["definition"].alias("definition"), "asked")


@query("join_reference_glosses", "J13 F26", rf"""
WITH p AS (SELECT p_partkey, p_brand, p_type, p_size, p_partkey % {len(_LEADS)} AS k, p_size % 5 <> 0 AND p_size % 7 <> 0 AS whole FROM part),
e AS (SELECT p_brand, count(*) AS senses, count(*) FILTER (p_size > 3) AS resolved, count(DISTINCT p_type) = 1 AS agree, min(p_type) AS text FROM part WHERE p_brand <> 'Brand#3' GROUP BY 1),
m AS (SELECT p_partkey, k = 5 AS sees, CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE p_type END AS ref FROM p WHERE whole AND k < 7)
SELECT p_partkey, m.ref, CASE WHEN sees THEN 0 ELSE coalesce(senses, 0) END AS senses, CASE WHEN sees THEN 0 ELSE coalesce(resolved, 0) END AS resolved,
  CASE WHEN NOT sees AND senses = resolved AND agree THEN text END AS text,
  CASE WHEN sees THEN 'not-an-equivalence-reference' WHEN senses IS NULL THEN 'exact-target-script-or-pinyin-unavailable' WHEN resolved < senses THEN 'target-has-unresolved-senses' WHEN NOT agree THEN 'target-has-conflicting-senses-or-pos' END AS reason
FROM m LEFT JOIN e ON m.ref = e.p_brand""")
def _(spark, d):
    p = table(spark, d, "part")
    of = r.source(_gloss("gloss"))
    ref = F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand")).otherwise(F.col("p_type"))
    found = references.mentions(p, "p_partkey", F.when(of.isNotNull(), F.array(F.struct(of["kind"].alias("kind"), ref.alias("ref")))))
    senses = p.where("p_brand <> 'Brand#3'").select(F.col("p_brand").alias("ref"), F.col("p_partkey").alias("sense"))
    seed = p.where("p_size > 3").select(F.col("p_partkey").alias("sense"), F.col("p_type").alias("text"), F.lit("adj").alias("cls"))
    return references.resolve(found, senses, seed).select("p_partkey", "ref", "senses", "resolved", "text", "reason")
