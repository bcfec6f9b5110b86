"""Phrase rules: the packs over glosses made of parts, and rules by the thousand, drawn from a table, over all documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from glossa.operators import phrase_packs as packs
from glossa.operators import phrase_rules as p
from glossa.plans.registry import query
from glossa.session import table

_LEADS = (
    "Watch out!", "Thank you,", "What happened? The", "lit. to ask for advice about the", "one who teaches the", "never ask about the", "to ask the price of a", "huge crowd near the", "to lose one's head for fear of a", "to lose one's head over a",
    "if three walk together,", "a still (for a", "rapid growth of the", "to make a mountain out of a molehill;", "practice of helping a", "to help oneself to a", "state of exhaustion /", "unable to sleep (", "not without progress, rapidly, as a", "a small", "a tool used for the", "person thinking of a", "thinking of the", "without a",
)
_NOUNS = {"ring": "object", "widget": "object", "bolt": "object", "gear": "object", "tool": "object", "valve": "household", "box": "household", "panel": "building", "spring": "nature", "idea": "conceptual"}


def _rules():
    rows = packs.rows()
    return rows + packs.noun_rows(_NOUNS, len(rows))


def _sql(x):
    return "[" + ", ".join(map(_sql, x)) + "]::varchar[]" if isinstance(x, list) else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)


_WORD = r"[\p{L}\p{N}]+(?:[''-][\p{L}\p{N}]+)*|[!?]"
_TABLE = "rules(rule, priority, phrase, place, also, without, after, kind, predicate, queries, related) AS (VALUES " + ", ".join("(" + ", ".join(map(_sql, r)) + ")" for r in _rules()) + ")"
_TEXTS = f"""t AS (SELECT p_partkey, ([{', '.join(_sql(x) for x in _LEADS)}])[p_partkey % {len(_LEADS)} + 1] || ' ' || p_name AS meaning FROM part),
c AS (SELECT p_partkey, replace(split_part(replace(regexp_replace(trim(regexp_replace(lower(meaning), '\\([^)]*\\)', ' ', 'g')), '^(?:(?:fig|lit|coll|esp|usu)\\.\\s*)+', ''), ';', '/'), '/', 1), '"', '') AS s FROM t),
w AS (SELECT p_partkey, ' ' || array_to_string(regexp_extract_all(s, '{_WORD}'), ' ') || ' ' AS x FROM c)"""


@query("classify_phrase_packs", "P09 X08 X09", f"""
WITH {_TABLE}, {_TEXTS},
k AS (SELECT *, ' ' || array_to_string(regexp_extract_all(phrase, '{_WORD}'), ' ') || ' ' AS ph FROM rules),
m AS (SELECT w.p_partkey, x, k.* FROM w JOIN k ON contains(x, ph) AND CASE place WHEN 'whole' THEN x = ph WHEN 'start' THEN starts_with(x, ph) WHEN 'end' THEN ends_with(x, ph) ELSE true END
  AND (len(also) = 0 OR len(list_filter(also, lambda a: contains(x, ' ' || a || ' '))) > 0) AND len(list_filter(without, lambda a: contains(x, ' ' || a || ' '))) = 0
  AND (len(after) = 0 OR len(list_filter(after, lambda a: contains(x, ph || a || ' '))) > 0)),
f AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY priority) = 1)
SELECT p_partkey, rule, kind, predicate, replace(queries[1], '{{text}}', trim(x)) AS query, coalesce(nullif(replace(queries[2], '{{text}}', trim(x)), queries[1]), replace(queries[1], '{{text}}', trim(x))) AS fallback, array_to_string(related, '|') AS related FROM f""")
def _(spark, d):
    lead = F.element_at(F.array(*[F.lit(x) for x in _LEADS]), (F.col("p_partkey") % len(_LEADS) + 1).cast("int"))
    rules = spark.createDataFrame(_rules(), p.SCHEMA)
    return p.plans(table(spark, d, "part"), ["p_partkey"], F.concat(lead, F.lit(" "), "p_name"), rules).select("p_partkey", "rule", "kind", "predicate", "query", "fallback", F.array_join("related", "|").alias("related"))


@query("classify_phrase_rules", "P09", rf"""
WITH b AS (SELECT item_id, regexp_extract_all(lower(text), '{_WORD}') AS ws FROM benchmark),
r AS (SELECT item_id, i, ws[i:i + 4] AS k FROM (SELECT item_id, ws, unnest(range(1, len(ws) - 3, 5)) AS i FROM b)),
d AS (SELECT doc_id, unnest(ls) AS l, generate_subscripts(ls, 1) - 1 AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)),
w AS (SELECT doc_id, line, regexp_extract_all(lower(replace(replace(l, '‘', ''''), '’', '''')), '{_WORD}') AS ws FROM d),
g AS (SELECT doc_id, line, i AS "at", ws[i:i + 4] AS k FROM (SELECT doc_id, line, ws, unnest(range(1, len(ws) - 3)) AS i FROM w))
SELECT doc_id, line, item_id AS priority, i AS nth, "at" FROM g JOIN r USING (k) QUALIFY row_number() OVER (PARTITION BY doc_id, line ORDER BY item_id, i, "at") = 1""")
def _(spark, d):
    # each run of five words of the benchmark, every fifth, is a rule: the first item that a line of a document quotes, and where
    b = table(spark, d, "benchmark").select("item_id", p.words(F.col("text")).alias("ws")).where(F.size("ws") >= 5)
    b = b.select("item_id", F.explode(F.transform(F.sequence(F.lit(1), F.size("ws") - 4, F.lit(5)), lambda i: F.struct(i.alias("i"), F.array_join(F.slice("ws", i, F.lit(5)), " ").alias("phrase")))).alias("r"))
    none = F.array().cast("array<string>")
    rules = b.select(F.lpad(F.col("r.i").cast("string"), 9, "0").alias("rule"), F.col("item_id").alias("priority"), "r.phrase", F.lit("any").alias("place"), none.alias("also"), none.alias("without"), none.alias("after"), F.col("r.i").cast("long").alias("nth"))
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "l"))
    found = p.match(lines, ["doc_id", "line"], F.col("l"), rules)
    return found.select("doc_id", F.col("line").cast("long").alias("line"), "priority", "nth", F.col("at").cast("long").alias("at"))
