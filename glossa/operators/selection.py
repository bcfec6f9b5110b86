"""Exact order statistics of groups of any size, without a task that holds or sorts a group."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossa.session import cut

FEW = 4096  # values between a group's bounds that one task may sort
CELLS = 256  # quantiles that a round's sketch tells
SALTS = 32  # places of a group's rows where the bounds are too many to be broadcast
BROADCAST_GROUPS = 100_000


def select_rank(df: DataFrame, group: str, value: str, rank: Callable[[Column], Column], few: int | None = None) -> DataFrame:
    """A10: (group, n, the value of rank `rank(n)` from 1) of every group; n counts the group's non-null values.

    All groups are narrowed at once. A round's sketch, partially aggregated, proposes two values around the rank; a
    second pass counts the rows below, at, between and above them, so the bounds that are kept are exact whatever the
    sketch's error is. Both values leave the interval, which keeps about a hundredth of its rows; one of `few` values
    at most is sorted. Ties cost nothing: a value that half of the rows share is counted. Null groups are one group.
    Groups of nulls only, and ranks outside 1 to n, give a null value. NaN is above all numbers.
    """
    few = FEW if few is None else few
    rows = df.select(F.col(group).alias("g"), F.col(value).alias("v")).where("v is not null")
    sizes = df.groupBy(F.col(group).alias("g")).agg(F.count(value).alias("n"))
    kind = df.schema[value].dataType
    none = F.lit(None).cast(kind)
    wanted = rank(F.col("n")).cast("long")
    state = sizes.select("g", "n", wanted.alias("r"), none.alias("lo"), none.alias("hi"), F.lit(0).cast("long").alias("below"), F.col("n").alias("inside"), none.alias("found"))
    state = cut(state.withColumn("open", F.coalesce(F.col("r").between(1, F.col("n")), F.lit(False))))
    while wide := state.where((F.col("inside") > few) & F.col("open")).count():
        told = state.where((F.col("inside") > few) & F.col("open"))
        step = _count(_between(rows, told, wide), _propose(_between(rows, told, wide), told), wide)
        state = cut(state.join(step, state["g"].eqNullSafe(step["__g"]), "left").select(*_narrowed()))
    rest = state.where("open")
    last = _between(rows, rest, rest.count()).groupBy("g").agg(F.array_sort(F.collect_list("v")).alias("vs"))  # `few` values at most
    last = last.select(F.col("g").alias("__g"), "vs")
    out = state.join(last, state["g"].eqNullSafe(last["__g"]), "left")
    return out.select(F.col("g").alias(group), "n", F.when(F.col("open"), F.get("vs", (F.col("r") - F.col("below") - 1).cast("int"))).otherwise(F.col("found")).alias(value))


def _near(rows: DataFrame, bounds: DataFrame, groups: int) -> DataFrame:
    """Rows with the bounds (__g, ...) of their group; a group's rows are spread over SALTS places if they must move."""
    if groups <= BROADCAST_GROUPS:
        return rows.join(F.broadcast(bounds), rows["g"].eqNullSafe(bounds["__g"]))
    salted = rows.withColumn("__s", F.pmod(F.spark_partition_id(), F.lit(SALTS)))  # by the scan's part, so a repeated task gives it again
    bounds = bounds.withColumn("__t", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(bounds, salted["g"].eqNullSafe(bounds["__g"]) & (F.col("__s") == F.col("__t"))).drop("__s", "__t")


def _between(rows: DataFrame, told: DataFrame, groups: int) -> DataFrame:
    """Rows strictly between their group's bounds; a missing bound bounds nothing."""
    near = _near(rows, told.select(F.col("g").alias("__g"), "lo", "hi"), groups)
    inside = (F.col("lo").isNull() | (F.col("v") > F.col("lo"))) & (F.col("hi").isNull() | (F.col("v") < F.col("hi")))
    return near.where(inside).select("g", "v")


def _propose(inside: DataFrame, told: DataFrame) -> DataFrame:
    """(__g, a, b): quantiles just below and just above the rank that is wanted."""
    places = [i / CELLS for i in range(CELLS + 1)]
    sketch = inside.groupBy("g").agg(F.percentile_approx("v", places, 100 * CELLS).alias("q")).select(F.col("g").alias("__g"), "q")
    at = F.floor((F.col("r") - F.col("below")) * CELLS / F.col("inside"))
    pick = lambda k: F.get("q", F.least(F.lit(CELLS), F.greatest(F.lit(0), k)).cast("int"))
    return told.join(sketch, told["g"].eqNullSafe(sketch["__g"])).select("__g", pick(at - 1).alias("a"), pick(at + 2).alias("b"))


def _count(inside: DataFrame, proposed: DataFrame, groups: int) -> DataFrame:
    """(__g, a, b, and how many rows are below a, at a, between, at b)."""
    near = _near(inside, cut(proposed), groups)
    v, a, b = F.col("v"), F.col("a"), F.col("b")
    parts = {"c0": v < a, "c1": v == a, "c2": (v > a) & (v < b), "c3": (v == b) & (a != b)}
    counted = near.groupBy("g").agg(F.first("a").alias("a"), F.first("b").alias("b"), *[F.count_if(x).alias(k) for k, x in parts.items()])
    return counted.withColumnRenamed("g", "__g")


def _narrowed() -> list[Column]:
    """The state after a round: found at one of the values, or the open interval that the rank lies in."""
    k = F.col("r") - F.col("below")
    c0, c1, c2, c3 = (F.col(f"c{i}") for i in range(4))
    up1, up2, up3 = c0 + c1, c0 + c1 + c2, c0 + c1 + c2 + c3
    hit = F.when((k > c0) & (k <= up1), F.col("a")).when((k > up2) & (k <= up3), F.col("b"))
    moved = F.col("a").isNotNull()

    def by(first: Column, second: Column, third: Column, keep: str) -> Column:
        return F.when(~moved, F.col(keep)).when(k <= c0, first).when((k > up1) & (k <= up2), second).when(k > up3, third).otherwise(F.col(keep)).alias(keep)

    return [
        F.col("g"), F.col("n"), F.col("r"),
        by(F.col("lo"), F.col("a"), F.col("b"), "lo"), by(F.col("a"), F.col("b"), F.col("hi"), "hi"),
        by(F.col("below"), F.col("below") + up1, F.col("below") + up3, "below"), by(c0, c2, F.col("inside") - up3, "inside"),
        F.coalesce("found", hit).alias("found"), (F.col("open") & ~F.coalesce(moved & hit.isNotNull(), F.lit(False))).alias("open"),
    ]
