"""Data quality: named rules, their issues, waterfalls and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def issues(rules: dict[str, Column]) -> Column:
    """The names of the rules that hold, in their order; a rule that is null does not hold."""
    return F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()]))


def waterfall(rules: dict[str, Column], otherwise: str) -> Column:
    """The first rule that holds, as exclusive categories."""
    return F.coalesce(*[F.when(rule, F.lit(name)) for name, rule in rules.items()], F.lit(otherwise))


def split_flags(found: Column, review: list[str], exempt: Column | None = None) -> Column:
    """Struct of hard errors and flags for review; exempt rows have no hard errors of the review kind."""
    kind = F.array(*[F.lit(x) for x in review])
    hard = F.array_except(found, kind)
    return F.struct((hard if exempt is None else F.when(exempt, F.array().cast("array<string>")).otherwise(hard)).alias("errors"), F.array_intersect(found, kind).alias("flags"))


def accept_batches(df: DataFrame, batch: str, found: Column) -> DataFrame:
    """The rows of batches in which no row has an issue; one bad row rejects its whole batch."""
    bad = df.where(F.size(found) > 0).select(F.col(batch).alias("__batch")).distinct()
    return df.join(bad, F.col(batch).eqNullSafe(F.col("__batch")), "left_anti")


def require(df: DataFrame, name: str, bad: Column) -> DataFrame:
    """Df, or an error if any row is bad."""
    if df.where(bad).limit(1).count():
        raise ValueError(f"{name} does not hold")
    return df
