"""Many phrase rules at once, the first by priority that meets a text.

Rules are rows, not a chain of conditions: they become an index by the first words of their
phrases, a text becomes its short runs of words, and one equi-join finds which rules may hold.
What is found is then compared in full with its guards. The plan has the same size for ten
rules as for a million, and a run of words that no rule begins with goes no further.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: place: whole, start, end or any; also: one of these must stand in the text, if any is given; without: none of these may; after: one of these must follow at once.
SCHEMA = "rule string, priority long, phrase string, place string, also array<string>, without array<string>, after array<string>, kind string, predicate string, queries array<string>, related array<string>"
#: Words of a phrase that the index is keyed by; longer phrases are compared in full after the join.
KEY_WORDS = 4
#: Rules are broadcast up to this many, and joined by a shuffle beyond.
BROADCAST_RULES = 50_000


def words(text: Column) -> Column:
    """Words in lower case: letters and digits, joined by apostrophes and hyphens; `!` and `?` are words of their own."""
    return F.regexp_extract_all(F.lower(F.regexp_replace(text, "[‘’]", "'")), F.lit(r"([\p{L}\p{N}]+(?:['-][\p{L}\p{N}]+)*|[!?])"), F.lit(1))


def _padded(ws: Column) -> Column:
    return F.concat(F.lit(" "), F.array_join(ws, " "), F.lit(" "))


def index(rules: DataFrame) -> DataFrame:
    """Rules with their words and key; rules without a word never hold."""
    rows = rules.withColumn("rule_words", words(F.col("phrase"))).where(F.size("rule_words") > 0)
    plain = lambda c: F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda p: F.array_join(words(p), " ")).alias(c)
    return rows.select("rule", "priority", "place", "rule_words", F.array_join(F.slice("rule_words", 1, KEY_WORDS), " ").alias("key"), plain("also"), plain("without"), plain("after"), *[c for c in rules.columns if c not in ("rule", "priority", "phrase", "place", "also", "without", "after")])


def _runs(ws: Column) -> Column:
    """Runs of up to KEY_WORDS words: (key, at)."""
    n = F.size(ws)

    def of(k: int) -> Column:
        at = F.when(n >= k, F.sequence(F.lit(1), F.greatest(n - (k - 1), F.lit(1)))).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.struct(F.array_join(F.slice(ws, i, F.lit(k)), " ").alias("key"), i.alias("at")))

    return F.concat(*[of(k) for k in range(1, KEY_WORDS + 1)])


def match(units: DataFrame, keys: list[str], text: Column, rules: DataFrame) -> DataFrame:
    """(keys, text, rule, priority, at and what the rule makes) of the first rule by priority that holds for each text.

    units: a row for each text, told apart by keys; texts that no rule meets give no row. Of rules
    of one priority the first by name holds, at its first place. Null texts have no words.
    """
    told = units.select(*keys, F.coalesce(words(text), F.array().cast("array<string>")).alias("text_words"))
    few = rules.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES
    ix = index(rules)
    runs = told.select(*keys, F.inline(_runs(F.col("text_words"))))
    hits = runs.join(F.broadcast(ix) if few else ix, "key").where((F.col("at") == 1) | F.col("place").isin("any", "end")).drop("key")
    rest = [c for c in ix.columns if c not in ("rule", "priority", "place", "rule_words", "key", "also", "without", "after")]
    both = hits.join(told, keys).withColumns({"n": F.size("rule_words"), "padded": _padded(F.col("text_words"))})
    has = lambda p: F.contains(F.col("padded"), F.concat(F.lit(" "), p, F.lit(" ")))
    tail = F.concat(F.lit(" "), F.array_join(F.slice("text_words", F.col("at") + F.col("n"), F.greatest(F.size("text_words"), F.lit(1))), " "), F.lit(" "))
    last = F.col("at") + F.col("n") - 1 == F.size("text_words")
    holds = (
        (F.slice("text_words", F.col("at"), F.col("n")) == F.col("rule_words"))
        & F.when(F.col("place").isin("whole", "end"), last).otherwise(True)
        & ((F.size("also") == 0) | F.exists("also", has))
        & ~F.exists("without", has)
        & ((F.size("after") == 0) | F.exists("after", lambda p: F.startswith(tail, F.concat(F.lit(" "), p, F.lit(" ")))))
    )
    first = both.where(holds).groupBy(*keys).agg(F.min_by(F.struct("rule", "priority", "at", F.array_join("text_words", " ").alias("text"), *rest), F.struct("priority", "rule", "at")).alias("m"))
    return first.select(*keys, "m.*")


def clean(meaning: Column) -> Column:
    """The phrase of a gloss that rules look at: without notes, labels and quotes, the first alternative."""
    low = F.regexp_replace(F.lower(F.regexp_replace(meaning, "[‘’]", "'")), r"\[[^\]]*\]|\([^)]*\)", " ")
    low = F.regexp_replace(F.trim(low), r"^(?:(?:fig|lit|coll|esp|usu)\.\s*)+", "")
    return F.trim(F.regexp_replace(F.get(F.split(low, "[;/]"), F.lit(0)), '["“”]', ""))


def plans(units: DataFrame, keys: list[str], meaning: Column, rules: DataFrame, limit: int = 100, most: int = 4) -> DataFrame:
    """(keys, rule, kind, predicate, query, fallback, queries, related): what each gloss shows by its first rule.

    {text} in a query is the gloss's phrase; queries of more than `limit` characters are left
    out, and there are `most` at most.
    """
    found = match(units, keys, clean(meaning), rules)
    made = F.slice(F.array_distinct(F.filter(F.transform("queries", lambda q: F.replace(q, F.lit("{text}"), F.col("text"))), lambda q: (q != "") & (F.length(q) <= limit))), 1, most)
    found = found.withColumn("made", made)
    query = F.get("made", F.lit(0))
    return found.select(*keys, "rule", "kind", "predicate", query.alias("query"), F.coalesce(F.get("made", F.lit(1)), query).alias("fallback"), F.col("made").alias("queries"), "related")
