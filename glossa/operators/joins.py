"""Joins of the curation pipeline, as compositions of equi-joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def keep_last(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """Of rows with equal keys the last one by order."""
    return _first(df, keys, [F.desc(c) if isinstance(c, str) else c.desc() for c in order])


def keep_first(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """Of rows with equal keys the first one by order."""
    return _first(df, keys, order)


def prefer(df: DataFrame, keys: list[str], preferences: list[Column], order: list) -> DataFrame:
    """Of rows with equal keys, the one that meets the earliest preference, else any; the first by order among equals."""
    rank = F.coalesce(*[F.when(p, F.lit(i)) for i, p in enumerate(preferences)], F.lit(len(preferences)))
    return _first(df, keys, [rank, *order])


def _first(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    return df.withColumn("__rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("__rn = 1").drop("__rn")


def guarded_overlay(base: DataFrame, overlay: DataFrame, keys: list[str], guard: Column, fields: dict[str, str], order: list) -> DataFrame:
    """Base with missing fields filled from the last overlay row of its key, where guard holds.

    fields: base column to overlay column. What base has already is never overwritten.
    """
    right = keep_last(overlay, keys, order)
    right = right.select(*keys, *[F.col(c).alias(f"__o_{c}") for c in right.columns if c not in keys])
    joined = base.join(right, keys, "left")
    filled = {b: F.coalesce(F.col(b), F.when(guard, F.col(f"__o_{o}"))) for b, o in fields.items()}
    return joined.withColumns(filled).select(*base.columns)


def divide(pairs: DataFrame, group: str, member: str, wanted: DataFrame, need: str = "need") -> DataFrame:
    """J09 to J11, relational division: (need, group) of groups that have every wanted member of need.

    wanted: (need, member), distinct or not. Counts meet after partial aggregation; no group is collected.
    """
    want = wanted.select(need, member).distinct()
    size = want.groupBy(need).agg(F.count("*").alias("__want"))
    have = pairs.select(group, member).distinct().join(want, member).groupBy(need, group).agg(F.count("*").alias("__have"))
    return have.join(size, need).where("__have = __want").select(need, group)


def only_match(matches: DataFrame, key: str) -> DataFrame:
    """Keys with exactly one match, and that match."""
    value = next(c for c in matches.columns if c != key)
    one = matches.distinct().groupBy(key).agg(F.count("*").alias("__n"), F.min(value).alias(value))
    return one.where("__n = 1").drop("__n")


def row_diff(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Keys and how each changed: added, removed or changed; equal rows do not appear."""

    def digest(df: DataFrame, name: str) -> DataFrame:
        rest = sorted(c for c in df.columns if c not in keys)
        return df.select(*keys, F.sha2(F.to_json(F.struct(*rest)), 256).alias(name))

    both = digest(old, "__a").join(digest(new, "__b"), keys, "full_outer")
    change = F.when(F.col("__a").isNull(), "added").when(F.col("__b").isNull(), "removed").when(F.col("__a") != F.col("__b"), "changed")
    return both.select(*keys, change.alias("change")).where("change is not null")


def zip_by_ordinal(left: DataFrame, right: DataFrame, ordinal: str, key: str) -> DataFrame:
    """Rows joined by position; `aligned` tells whether their keys agree."""
    r = right.select(ordinal, *[F.col(c).alias(f"r_{c}") for c in right.columns if c != ordinal])
    return left.join(r, ordinal).withColumn("aligned", F.col(key).eqNullSafe(F.col(f"r_{key}")))


def ordered_digest(df: DataFrame, key: str, line: str, fanout: int = 1000) -> DataFrame:
    """One row (digest, rows_): SHA-256 over the lines in key order, as a tree of two levels of `fanout` keys each.

    Keys are integers from 0 on. A task joins the lines of `fanout` keys, so no task sees the table whole;
    the root joins one digest for each fanout * fanout keys.
    """
    level = df.select(F.floor(F.col(key) / fanout).alias("k"), F.col(key).alias("i"), F.col(line).alias("s"), F.lit(1).alias("n"))
    for up in (fanout, None):
        text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "s"))), lambda r: r["s"]), "\n")
        level = level.groupBy("k").agg(F.sha2(text, 256).alias("s"), F.sum("n").alias("n"))
        level = level.select(F.floor(F.col("k") / up).alias("k") if up else F.lit(0).alias("k"), F.col("k").alias("i"), "s", "n")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "s"))), lambda r: r["s"]), "\n")
    return level.agg(F.sha2(text, 256).alias("digest"), F.sum("n").alias("rows_"))
