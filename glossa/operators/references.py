"""Cross-references between entries, resolved against answers that were frozen before.

A row may mention several entries. A mention is answered only if every sense of the entry it
names has an answer in the seed, and all of them agree on their terms and class: one convenient
sense is not enough. Answers never feed other answers, so nothing is recursive: two joins and a
grouped fold, whatever refers to what.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossa.functions.references import EQUIVALENCES, terms_key

#: Answers (an entry, a text and counts) come back to the mentions by broadcast up to this many, by a shuffle beyond.
BROADCAST_ENTRIES = 100_000
#: A mention of a kind that asserts nothing, of an entry that is not there, of one with an open sense, of one whose senses differ (fixed values).
NOT_EQUIVALENT, UNKNOWN, UNRESOLVED, CONFLICTING = "not-an-equivalence-reference", "exact-target-script-or-pinyin-unavailable", "target-has-unresolved-senses", "target-has-conflicting-senses-or-pos"


def mentions(rows: DataFrame, key: str, found: Column) -> DataFrame:
    """(key, nth, kind, ref): the mentions of each row, in order. found: an array of structs (kind, ref)."""
    each = rows.select(key, F.posexplode(found).alias("nth", "m"))
    return each.select(key, "nth", "m.kind", "m.ref")


def fold_entries(senses: DataFrame, seed: DataFrame) -> DataFrame:
    """(ref, senses, resolved, text, cls, reason) of each entry. senses: (ref, sense); seed: (sense, text, cls), a row a sense.

    text and cls are those of the first sense, null with a reason. Only counts and extremes meet,
    so an entry of very many senses costs a row a task.
    """
    told = senses.join(seed.select("sense", "text", "cls", terms_key(F.col("text")).alias("terms")), "sense", "left")
    folded = told.groupBy("ref").agg(
        F.count("*").alias("senses"),
        F.count("terms").alias("resolved"),
        F.min("terms").alias("low"),
        F.max("terms").alias("high"),
        F.count("cls").alias("classed"),
        F.min("cls").alias("first_cls"),
        F.max("cls").alias("last_cls"),
        F.min_by("text", "sense").alias("text"),
    )
    one_class = (F.col("classed") == 0) | ((F.col("classed") == F.col("senses")) & (F.col("first_cls") == F.col("last_cls")))
    reason = F.when(F.col("resolved") < F.col("senses"), UNRESOLVED).when((F.col("low") != F.col("high")) | ~one_class, CONFLICTING)
    return folded.select("ref", "senses", "resolved", F.when(reason.isNull(), F.col("text")).alias("text"), F.when(reason.isNull(), F.col("first_cls")).alias("cls"), reason.alias("reason"))


def resolve(found: DataFrame, senses: DataFrame, seed: DataFrame, equivalences: tuple[str, ...] = EQUIVALENCES) -> DataFrame:
    """found (mentions) with senses and resolved (counts), text and cls of the entry named, or the reason why there is none.

    Mentions with a null reference name an unknown entry; repeated mentions each get their answer.
    Rows of senses or of the seed that repeat count once; a sense with several rows in the seed
    is answered by the smallest text. Only entries that are mentioned are folded.
    """
    asks = F.col("kind").isin(*equivalences)
    asked = found.where(asks).select("ref").distinct()
    mine = senses.select("ref", "sense").where("ref is not null").distinct().join(asked, "ref", "left_semi")
    one = seed.where("text is not null").groupBy("sense").agg(F.min(F.struct("text", "cls")).alias("a")).select("sense", "a.text", "a.cls")
    answers = fold_entries(mine, one)
    few = asked.limit(BROADCAST_ENTRIES + 1).count() <= BROADCAST_ENTRIES
    told = found.join(F.broadcast(answers) if few else answers, "ref", "left")
    reason = F.when(~asks, NOT_EQUIVALENT).when(F.col("senses").isNull(), UNKNOWN).otherwise(F.col("reason"))
    shown = lambda c: F.when(reason.isNull(), F.col(c)).alias(c)
    count = lambda c: F.when(asks, F.coalesce(c, F.lit(0).cast("long"))).otherwise(0).alias(c)
    return told.select(*found.columns, count("senses"), count("resolved"), shown("text"), shown("cls"), reason.alias("reason"))
