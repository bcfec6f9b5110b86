"""Scalar functions over names, glosses, documents and URLs."""

from __future__ import annotations

from pyspark.sql import functions as F

from glossa.functions import text as t
from glossa.functions import urls as u
from glossa.plans.registry import query
from glossa.session import table

_NORM = r"regexp_replace(regexp_replace(strip_accents(replace(replace(lower(trim({0})), 'u:', 'v'), 'ü', 'v')), '([a-z])[1-5]', '\1', 'g'), '[\s''’\-]', '', 'g')"
_TERMS = r"trim(regexp_replace(strip_accents(lower({0})), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"
_SQUEEZE = r"trim(regexp_replace({0}, '\s+', ' ', 'g'))"


@query("text_norm_key", "F01 S19", "SELECT c_custkey, " + _NORM.format("c_name || ' Lü4 Píng'") + " AS norm_key FROM customer")
def _(spark, d):
    return table(spark, d, "customer").select("c_custkey", t.norm_key(F.concat("c_name", F.lit(" Lü4 Píng"))).alias("norm_key"))


@query("text_tone_marks", "F02", """
SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'liú shuǐ' WHEN 1 THEN 'xué' WHEN 2 THEN 'lǜ' WHEN 3 THEN 'dōu' ELSE 'Zhōng ma' END AS marked FROM part""")
def _(spark, d):
    i = F.col("p_partkey") % 5
    raw = F.when(i == 0, "liu2 shui3").when(i == 1, "xue2").when(i == 2, "lv4").when(i == 3, "dou1").otherwise("Zhong1 ma5")
    return table(spark, d, "part").select("p_partkey", t.tone_marks(raw).alias("marked"))


@query("text_display_meaning", "F03", r"SELECT p_partkey, trim(regexp_replace(p_name || ' (CL:個|个[ge4])', '\s*\(CL:[^)]*\)', '', 'g')) AS shown FROM part")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", t.display_meaning(F.concat("p_name", F.lit(" (CL:個|个[ge4])"))).alias("shown"))


@query("text_norm_terms", "F04", "SELECT doc_id, " + _TERMS.format("text") + " AS terms FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", t.norm_terms(F.col("text")).alias("terms"))


@query("text_grams", "F05 A26", """
WITH g AS (SELECT p_partkey, unnest(list_distinct(list_transform(range(1, length(p_name) - 1), lambda i: substring(p_name, i, 3)))) AS gram FROM part)
SELECT gram, count(*) AS n FROM g GROUP BY gram""")
def _(spark, d):
    return table(spark, d, "part").select(F.explode(t.grams(F.col("p_name"))).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))


@query("text_near", "F06", """
WITH n AS (SELECT n_nationkey AS a_key, lower(n_name) AS a FROM nation),
p AS (SELECT a_key, a, CASE a_key % 4 WHEN 0 THEN a[2:2] || a[1:1] || a[3:] WHEN 1 THEN a[2:] WHEN 2 THEN 'x' || a[2:] ELSE a END AS b FROM n)
SELECT a_key, b, damerau_levenshtein(a, b) = 1 AS near FROM p""")
def _(spark, d):
    a = F.lower("n_name")
    k = F.col("n_nationkey") % 4
    b = F.when(k == 0, F.concat(a.substr(F.lit(2), F.lit(1)), a.substr(F.lit(1), F.lit(1)), a.substr(F.lit(3), F.lit(99)))).when(k == 1, a.substr(F.lit(2), F.lit(99))).when(k == 2, F.concat(F.lit("x"), a.substr(F.lit(2), F.lit(99)))).otherwise(a)
    return table(spark, d, "nation").select(F.col("n_nationkey").alias("a_key"), b.alias("b"), t.near(a, b).alias("near"))


@query("text_norm_gloss", "F07 F08", r"""
SELECT doc_id, regexp_replace(regexp_replace(lower(""" + _SQUEEZE.format("split_part(text, chr(10), 1)") + r"""), '^(?:a|an|the|to) ', ''), '\.$', '') AS gloss FROM documents""")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", t.norm_gloss(F.split("text", "\n").getItem(0)).alias("gloss"))


@query("text_norm_pos", "F09 F34", """
SELECT p_partkey, CASE lower(c) WHEN 'n' THEN 'noun' WHEN 'v' THEN 'verb' WHEN 'a' THEN 'adj' WHEN 's' THEN 'adj' WHEN 'r' THEN 'adv' ELSE lower(c) END AS pos
FROM (SELECT p_partkey, substring('NVASRX', CAST(p_partkey % 6 AS INT) + 1, 1) AS c FROM part)""")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", t.norm_pos(F.lit("NVASRX").substr((F.col("p_partkey") % 6).cast("int") + 1, F.lit(1))).alias("pos"))


@query("text_idiom_labels", "F10", """
SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN true WHEN 1 THEN true ELSE false END AS tagged,
       CASE n_nationkey % 3 WHEN 0 THEN lower(n_name) WHEN 1 THEN 'to ' || lower(n_name) ELSE lower(n_name) || ' (cf the idiom)' END AS normalized,
       CASE n_nationkey % 3 WHEN 0 THEN 1 ELSE 0 END AS n_labels FROM nation""")
def _(spark, d):
    k = F.col("n_nationkey") % 3
    c = F.when(k == 0, F.concat(F.lower("n_name"), F.lit(" (idiom)"))).when(k == 1, F.concat(F.lit("fig. to "), F.lower("n_name"))).otherwise(F.concat(F.lower("n_name"), F.lit(" (cf the idiom)")))
    s = t.idiom_labels(c)
    return table(spark, d, "nation").select("n_nationkey", s["tagged"].alias("tagged"), s["normalized"].alias("normalized"), F.size(s["labels"]).alias("n_labels"))


@query("text_alternatives", "F11", """
SELECT p_partkey, 'big (a,b)|' || lower(p_brand) AS parts FROM part WHERE p_partkey % 2 = 0
UNION ALL SELECT p_partkey, 'fig. ' || lower(p_brand) FROM part WHERE p_partkey % 2 = 1""")
def _(spark, d):
    c = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("big (a;b); "), F.lower("p_brand"))).otherwise(F.concat(F.lit("small / fig. "), F.lower("p_brand")))
    return table(spark, d, "part").select("p_partkey", F.array_join(t.alternatives(c), "|").alias("parts"))


def _nested(spark, d):
    """Lines of all documents with common letters as parentheses and separators: dozens of levels, most of them without a partner somewhere."""
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "l"))
    return lines.select("doc_id", F.col("line").cast("long").alias("line"), F.translate("l", "ensr", "();/").alias("l"))


_NESTED = """n AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents),
s AS (SELECT doc_id, line, translate(l, 'ensr', '();/') AS s FROM n)"""


@query("text_alternatives_of_lines", "F11", r"""
WITH """ + _NESTED + r""", g AS (SELECT doc_id, line, array_to_string(list_transform(regexp_extract_all(s, '\([^)]*\)|[^(]+|\('), lambda x: CASE WHEN starts_with(x, '(') THEN translate(x, ';/', ',,') ELSE x END), '') AS s FROM s)
SELECT doc_id, line, array_to_string(list_filter(list_transform(string_split_regex(s, '[;/]'), lambda x: trim(x)), lambda x: x <> ''), '|') AS parts FROM g""")
def _(spark, d):
    return _nested(spark, d).select("doc_id", "line", F.array_join(t.alternatives(F.col("l")), "|").alias("parts"))


@query("text_nested_parentheses", "F14", r"""
WITH RECURSIVE """ + _NESTED + r""", r AS (SELECT doc_id, line, s FROM s UNION ALL SELECT doc_id, line, regexp_replace(s, '\([^()]*\)', ' ', 'g') FROM r WHERE regexp_matches(s, '\([^()]*\)'))
SELECT doc_id, line, trim(regexp_replace(s, '\s+', ' ', 'g')) AS plain FROM r WHERE NOT regexp_matches(s, '\([^()]*\)')""")
def _(spark, d):
    return _nested(spark, d).select("doc_id", "line", t.without_parentheses(F.col("l")).alias("plain"))


_FILLERS = ", ".join("'" + w.replace("'", "''") + "'" for w in t.FILLERS)


@query("text_content_words", "F12 F33 P11", rf"""
WITH x AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(lower(text), '\[[^\]]*\]', ' ', 'g'), '\b\w+[''’]s\b', ' ', 'g'), '\b(?:lit|fig|coll|usu|esp)\.', ' ', 'g') AS t FROM documents),
w AS (SELECT doc_id, list_distinct(regexp_extract_all(t, '[a-z]+(?:-[a-z]+)*')) AS ws FROM x),
k AS (SELECT doc_id, list_filter(ws, lambda w: length(w) > 1 AND NOT list_contains([{_FILLERS}], w)) AS ws FROM w)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, list_aggregate(ws, 'min') AS first_word, len(list_filter(ws, lambda w: length(w) > 12)) > 0 AS has_long FROM k""")
def _(spark, d):
    w = t.content_words(F.col("text"))
    return table(spark, d, "documents").select("doc_id", w.alias("w")).select("doc_id", F.size("w").cast("long").alias("n_words"), F.array_min("w").alias("first_word"), F.exists("w", lambda x: F.length(x) > 12).alias("has_long"))


@query("text_semantic_english", "F13", r"""
WITH a AS (SELECT item_id, regexp_replace(regexp_replace(strip_accents(text), '\[[^\]]*\]', ' ', 'g'), '[\p{Han}\p{Bopomofo}\p{Hiragana}\p{Katakana}]+(?:\|\p{Han}+)?|[|]', ' ', 'g') AS t FROM benchmark),
b AS (SELECT item_id, replace(replace(replace(replace(regexp_replace(t, '["“”]', '', 'g'), '‘', chr(39)), '’', chr(39)), '–', '-'), '—', '-') AS t FROM a),
c AS (SELECT item_id, regexp_replace(regexp_replace(t, '\.([^\d]|$)', ' \1', 'g'), '\.([^\d]|$)', ' \1', 'g') AS t FROM b)
SELECT item_id, trim(regexp_replace(regexp_replace(replace(replace(replace(t, '&', ' and '), '°', ' degrees '), '%', ' percent '), '[<>={}#_*~+]', ' ', 'g'), '\s+', ' ', 'g')) AS clause FROM c""")
def _(spark, d):
    return table(spark, d, "benchmark").select("item_id", t.semantic_english(F.col("text")).alias("clause"))


@query("text_without_parentheses", "F14 F15", r"""
SELECT p_partkey, lower(p_name) AS plain, split_part(lower(p_name), ',', 1) AS meaning FROM part""")
def _(spark, d):
    c = F.concat(F.lit("(old (very (rare))) "), F.lower("p_name"), F.lit(" (n)"))
    return table(spark, d, "part").select("p_partkey", t.without_parentheses(c).alias("plain"), t.visual_meaning(F.concat(F.lit("The (x) "), F.col("p_name"))).alias("meaning"))


@query("text_participle", "F16 F17", """
SELECT w, CASE WHEN regexp_matches(w, 'ie$') THEN left(w, -2) || 'ying' WHEN regexp_matches(w, '[^e]e$') THEN left(w, -1) || 'ing'
  WHEN regexp_matches(w, '^[^aeiou]*[aeiou][^aeiouwxy]$') THEN w || right(w, 1) || 'ing' ELSE w || 'ing' END AS ing, n
FROM (SELECT w, count(*) AS n FROM (SELECT unnest(string_split(lower(p_name), ' ')) AS w FROM part UNION ALL SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) FROM documents) GROUP BY 1)""")
def _(spark, d):
    named = table(spark, d, "part").select(F.explode(F.split(F.lower("p_name"), " ")).alias("w"))
    written = table(spark, d, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), F.lit(1))).alias("w"))
    words = named.union(written).groupBy("w").agg(F.count("*").alias("n"))
    return words.select("w", t.participle(F.col("w")).alias("ing"), "n")


@query("text_word_forms", "F17", """
WITH v AS (SELECT DISTINCT unnest(string_split(lower(p_name), ' ')) AS w FROM part),
f AS (SELECT w, unnest([w, regexp_replace(w, 'ies$', 'y'), regexp_replace(w, 'e?s$', ''), regexp_replace(w, 'ing$', ''), regexp_replace(w, 'ing$', 'e'), regexp_replace(w, 'e?d$', '')]) AS form FROM v)
SELECT DISTINCT f.w, form FROM f JOIN v ON f.form = v.w WHERE length(form) > 1""")
def _(spark, d):
    words = table(spark, d, "part").select(F.explode(F.split(F.lower("p_name"), " ")).alias("w")).distinct()
    forms = words.select("w", F.explode(t.word_forms(F.col("w"))).alias("form"))
    return forms.join(words.select(F.col("w").alias("form")), "form").select("w", "form").distinct()


@query("text_query_identity", "F18", """
WITH w AS (SELECT p_partkey, list_distinct(regexp_extract_all(lower(p_name || ' of the red picture'), '[a-z]+')) AS ws FROM part)
SELECT p_partkey, array_to_string(list_sort(list_filter(ws, lambda w: NOT list_contains(['a','an','the','to','of','for','and','or','with','in','on','at','person','people','someone','something','one','ones','photo','image','illustration','picture','generic','red','blue','green','yellow','background'], w))), ' ') AS identity FROM w""")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", t.query_identity(F.concat("p_name", F.lit(" of the red picture"))).alias("identity"))


@query("text_evidence", "F19", r"""
SELECT doc_id, line, CASE WHEN length(l) > 240 OR len(regexp_extract_all(l, '[A-Za-z]+')) > 24 OR regexp_matches(l, '(?i)\b(?:i|my|mine|me|we|our|ours|us)\b|https?://|\b(?:photographed|photographer|camera|copyright)\b') THEN '' ELSE lower(l) END AS evidence
FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents)""")
def _(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "l"))
    return rows.select("doc_id", F.col("line").cast("long").alias("line"), t.evidence(F.col("l")).alias("evidence"))


@query("text_bounded_query", "F38 F40 F39", f"""
SELECT p_partkey, lower(p_name) AS query, CASE p_partkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 10 ELSE 40 END + least(6, len(list_filter(list_distinct(regexp_extract_all(lower(p_name), '[a-z]+')), lambda w: length(w) > 1 AND NOT list_contains([{_FILLERS}], w)))) + CASE WHEN p_partkey % 2 = 0 THEN 5 ELSE 0 END AS score FROM part""")
def _(spark, d):
    words = F.split(F.lower("p_name"), " ")
    q = t.bounded_query(words)
    k = F.col("p_partkey")
    return table(spark, d, "part").select("p_partkey", t.visual_query(q).alias("query"), t.visual_score(F.col("p_name"), k % 3 == 0, k % 3 == 1, k % 2 == 0).cast("long").alias("score"))


@query("text_positive_action", "F41 F42", "SELECT n_nationkey, 'see ' || lower(n_name) AS action, 'Translate: see ' || lower(n_name) AS prompt FROM nation")
def _(spark, d):
    a = t.positive_action(F.concat(F.lit("not afraid to see "), F.col("n_name")))
    return table(spark, d, "nation").select("n_nationkey", a.alias("action"), F.format_string("Translate: %s", a).alias("prompt"))


@query("text_cues", "F36", r"SELECT doc_id, regexp_matches(lower(text), '\b(the|und|les)\b') AS hit FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", t.has_cue(F.col("text"), ["the", "und", "les"]).alias("hit"))


@query("text_hash_keys", "F24 F25 F37", """
SELECT o_orderkey, substring(sha256('["' || o_orderkey || '","' || o_orderstatus || '","' || o_orderpriority || '"]'), 1, 16) AS tag FROM orders""")
def _(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.substring(F.sha2(t.json_key(F.col("o_orderkey"), F.col("o_orderstatus"), F.col("o_orderpriority")), 256), 1, 16).alias("tag"))


@query("text_coalesce_labels", "F28 F29 F30", """
SELECT o_orderkey, COALESCE(CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END, o_orderstatus) AS content,
  CASE WHEN o_orderstatus = 'F' THEN 'final' WHEN o_totalprice > 200000 THEN 'large' ELSE 'open' END AS label,
  'CC ' || o_orderstatus || COALESCE(' ' || CASE WHEN o_orderkey % 2 = 0 THEN '4.0' END, '') AS license FROM orders""")
def _(spark, d):
    s = F.col("o_orderstatus")
    return table(spark, d, "orders").select(
        "o_orderkey", F.coalesce(F.when(s == "F", F.col("o_orderpriority")), s).alias("content"),
        F.when(s == "F", "final").when(F.col("o_totalprice") > 200000, "large").otherwise("open").alias("label"),
        F.concat_ws(" ", F.lit("CC"), s, F.when(F.col("o_orderkey") % 2 == 0, "4.0")).alias("license"))


@query("text_math", "F23 F31 P12", """
SELECT l_orderkey, l_linenumber, round(least(2.0, log2(l_quantity * 20 * 400 / 120000.0)) - abs(log2(l_quantity * 20 / 400)), 6) AS usability,
  CAST(floor(l_extendedprice / 100) AS BIGINT) % 7 AS bucket FROM lineitem WHERE l_quantity * 20 >= 300 AND l_quantity * 20 / 400.0 BETWEEN 0.2 AND 5""")
def _(spark, d):
    w, h = F.col("l_quantity") * 20, F.lit(400.0)
    rows = table(spark, d, "lineitem").where((w >= 300) & (w / h).between(0.2, 5))
    return rows.select("l_orderkey", "l_linenumber", F.round(u.usability(w, h), 6).alias("usability"), (F.floor(F.col("l_extendedprice") / 100) % 7).alias("bucket"))


@query("text_json_maps", "F32 F34 S06 U06", """
SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, json_keys(props) = ['k'] AS only_k, '{"K":' || CAST(CAST(json_extract(props, '$.k') AS BIGINT) + 1 AS VARCHAR) || '}' AS raised FROM events""")
def _(spark, d):
    m = F.from_json("props", "map<string,bigint>")
    raised = F.to_json(F.transform_values(F.transform_keys(m, lambda k, v: F.upper(k)), lambda k, v: v + 1))
    return table(spark, d, "events").select("event_id", m["k"].alias("k"), (F.array_sort(F.map_keys(m)) == F.array(F.lit("k"))).alias("only_k"), raised.alias("raised"))


@query("text_time", "F35 W17", """
SELECT event_id, epoch_us(ts) // 86400000000 AS day_index, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS iso, epoch_us(ts) // 1000 + 86400000 AS expires FROM events""")
def _(spark, d):
    return table(spark, d, "events").select("event_id", F.floor(F.unix_millis(F.col("ts").cast("timestamp")) / 86400000).alias("day_index"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("iso"), (F.unix_millis(F.col("ts").cast("timestamp")) + 86400000).alias("expires"))


_Q = "array_to_string(list_sort(list_filter(string_split(split_part(url, '?', 2), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^(?:utm_.*|ref|fbclid|gclid)(?:=|$)'))), '&')"


@query("url_source_identity", "F20 F21 S18", f"""
SELECT page_id, regexp_replace(regexp_extract(url, '^https?://([^/?#]+)', 1), '^www\\.', '') || regexp_replace(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), '/$', '') || CASE WHEN {_Q} = '' THEN '' ELSE '?' || {_Q} END AS identity FROM pages""")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", u.source_identity(F.col("url")).alias("identity"))


@query("url_public", "P13", r"""
SELECT page_id, regexp_matches(url, '^https://[^/?#@:]+([/?#]|$)') AND NOT regexp_matches(regexp_extract(url, '^https?://([^/?#]+)', 1), '(^|\.)(localhost|local|internal|test|invalid)$')
  AND regexp_matches(regexp_extract(url, '^https?://([^/?#]+)', 1), '^[a-z0-9-]+(\.[a-z0-9-]+)+$') AND NOT regexp_matches(regexp_extract(url, '^https?://([^/?#]+)', 1), '^[\d.]+$') AS public FROM pages""")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", u.is_public_https(F.col("url")).alias("public"))


@query("url_fnv1a", "F22", """
WITH RECURSIVE s AS (SELECT page_id, url, 0 AS i, 2166136261::BIGINT AS h FROM pages
UNION ALL SELECT page_id, url, i + 1, (xor(h, ascii(url[i + 1])::BIGINT) * 16777619) & 4294967295 FROM s WHERE i < length(url))
SELECT page_id, h AS hash FROM s WHERE i = length(url)""")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", u.fnv1a(F.col("url")).alias("hash"))


@query("text_relations_format", "F43 P02 K07", """
SELECT conv_id, string_agg(turn || '. ' || role || ': ' || text, ' | ' ORDER BY turn, role, text) AS sheet, count(*) AS turns FROM conversations GROUP BY conv_id""")
def _(spark, d):
    lines = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    shown = F.transform(lines, lambda s: F.concat(s["turn"].cast("string"), F.lit(". "), s["role"], F.lit(": "), s["text"]))
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.array_join(shown, " | ").alias("sheet"), F.count("*").alias("turns"))
