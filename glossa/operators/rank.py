"""Candidate ranking: relevance, deterministic order, greedy diversity."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossa.operators.sample import numbered
from glossa.session import cut, ensure_checkpoint_dir, remove


#: Rows chosen so far, in all groups, that may be broadcast to the candidates; more are joined by a shuffle.
BROADCAST_CHOSEN = 10_000


def relevance(tokens: Column, exact: Column, related: Column, context: Column, priority: Column, caption_only: Column) -> Column:
    """300, 200 or 30 by the best set of terms that tokens meet, 3 for each of up to nine terms, up to 5 for an
    early candidate, 35 off for captions only; -1 if no set is met."""
    met = [F.size(F.array_intersect(tokens, s)) for s in (exact, related, context)]
    base = F.when(met[0] > 0, 300).when(met[1] > 0, 200).when(met[2] > 0, 30)
    score = base + 3 * F.least(F.lit(9), met[0] + met[1] + met[2]) + F.greatest(F.lit(0), 5 - priority) - F.when(caption_only, 35).otherwise(0)
    return F.coalesce(score, F.lit(-1))


def facets(tokens: Column, cues: dict[str, list[str]], most: int = 6) -> Column:
    """The facets whose cues meet the tokens, in their order."""
    found = F.array_compact(F.array(*[F.when(F.arrays_overlap(tokens, F.array(*[F.lit(c) for c in words])), F.lit(name)) for name, words in cues.items()]))
    return F.slice(found, 1, most)


def cluster_key(facet_col: Column, symbolic: Column, human: Column) -> Column:
    """What a candidate shows, as one key: a symbol, its facets, else a person, else the subject alone."""
    own = F.array_sort(F.array_except(facet_col, F.array(F.lit("subject"))))
    return F.when(symbolic, "symbol").when(F.size(own) > 0, F.array_join(own, "+")).when(human, "human-subject").otherwise("subject")


def diverse_top(df: DataFrame, group: str, id_col: str, score: str, facet_col: str, term_col: str, k: int = 20, symbolic: Column | None = None,
                human: Column | None = None, importance: dict[str, float] | None = None, human_scenes: bool = False) -> DataFrame:
    """W20 for each group: (group, id, pos): a greedy choice from all rows of the group.

    At each step the row with the highest sum wins, ties by score, then id: its score; 38 times
    the importance (1 unless given) of each facet not shown yet; 30 if it shows people and the
    group is of human scenes; less min(180, 18 r + 3 r^2) for r rows chosen of its cluster, 30
    times the largest Jaccard similarity of its terms to a chosen row's, and, for a symbol, 120
    for each symbol chosen. A group of human scenes that has any takes one symbol at most. In a
    group of two clusters or more within 110 of the best score, a cluster shows the same terms
    twice at most. Without facets, a row's facet is the subject, which counts for nothing.

    Terms are compared by 64-bit hashes. A row's sum without its terms is an upper bound, and terms
    cost 30 at most: only rows whose bound is within 30 of their group's best have their terms
    read and compared. Each step is two partially aggregated extremes over all rows, so no group
    reaches one task whole.
    """
    spark = df.sparkSession
    no = F.lit(False)
    symbol, person = F.coalesce(no if symbolic is None else symbolic, no), F.coalesce(no if human is None else human, no)
    terms, facet_set = (F.array_distinct(F.coalesce(F.col(c), F.array())) for c in (term_col, facet_col))
    rows = df.select(F.col(group).alias("g"), F.col(id_col).alias("i"), F.coalesce(F.col(score).cast("double"), F.lit(float("-inf"))).alias("score"), facet_set.alias("f"), F.array_sort(F.transform(terms, lambda x: F.xxhash64(x))).alias("t"),
                     symbol.alias("symbol"), (person & ~symbol).alias("person"), F.monotonically_increasing_id().alias("row"))
    rows = rows.withColumn("cluster", cluster_key(F.col("f"), F.col("symbol"), F.col("person"))).withColumn("sign", F.xxhash64("cluster", "t"))
    folder = f"{ensure_checkpoint_dir(spark)}/gallery-{uuid.uuid4().hex}"
    rows.repartition("row").write.parquet(folder)  # spread once for all steps; by columns: bounds are found without reading terms
    rows = spark.read.schema(rows.schema).parquet(folder)
    top = rows.groupBy("g").agg(F.greatest(F.lit(0.0), F.max("score")).alias("best"), F.max("person").alias("people"))
    near = rows.groupBy("g", "cluster").agg(F.max("score").alias("score")).join(top.withColumnRenamed("g", "of"), F.col("g").eqNullSafe(F.col("of")))
    kinds = cut(near.groupBy("g").agg((F.count_if(F.col("score") >= F.col("best") - 110) >= 2).alias("several"), (F.max("people") & F.lit(human_scenes)).alias("scenes")))
    few = kinds.count() * k <= BROADCAST_CHOSEN

    def gain(fresh: Column) -> Column:
        own = F.transform(F.array_except(fresh, F.array(F.lit("subject"))), lambda x: 38 * _weight(x, importance))
        return F.aggregate(own, F.lit(0.0), lambda s, x: s + x)

    def of_group(left: DataFrame, right: DataFrame) -> DataFrame:
        right = right.withColumnRenamed("g", "of")
        return left.join(F.broadcast(right) if few else right, F.col("g").eqNullSafe(F.col("of"))).drop("of")

    scenes = F.when(F.lit(human_scenes) & F.col("person"), 30).otherwise(0)
    chosen = None
    for pos in range(1, k + 1):
        now, value = rows, F.col("score") + gain(F.col("f")) + scenes
        if chosen is not None:
            state = chosen.groupBy("g").agg(F.collect_list("row").alias("rows"), F.collect_list("cluster").alias("clusters"), F.collect_list("sign").alias("signs"), F.array_distinct(F.flatten(F.collect_list("f"))).alias("seen"), F.count_if(F.array_contains("f", "symbol")).alias("symbols"))
            now = of_group(rows, of_group(state, kinds)).where(~F.array_contains("rows", F.col("row")))
            now = now.where(~(F.col("scenes") & (F.col("symbols") >= 1) & F.col("symbol"))).where(~F.col("several") | (F.size(F.filter("signs", lambda x: x == F.col("sign"))) < 2))
            now = now.withColumn("r", F.size(F.filter("clusters", lambda x: x == F.col("cluster"))))
            gained = F.col("score") + gain(F.array_except("f", "seen")) + scenes
            less = F.least(F.lit(180), 18 * F.col("r") + 3 * F.col("r") * F.col("r"))
            symbols = F.when(F.col("symbol"), 120 * F.col("symbols")).otherwise(0)
            now = now.withColumns({"gained": gained, "less": less, "symbol_less": symbols, "bound": gained - less - symbols})
            now = of_group(now, now.groupBy("g").agg(F.max("bound").alias("most"))).where(F.col("bound") >= F.col("most") - 30.001)
            now = of_group(now, chosen.groupBy("g").agg(F.collect_list("t").alias("ts")))
            both = lambda x: F.size(F.array_intersect("t", x))
            alike = F.array_max(F.transform("ts", lambda x: both(x) / F.greatest(F.lit(1), F.size("t") + F.size(x) - both(x))))
            value = F.col("gained") - (F.col("less") + 30 * alike + F.col("symbol_less"))
        best = now.groupBy("g").agg(F.min(F.struct((-value).alias("v"), (-F.col("score")).alias("s"), "i", "row", "t", "f", "cluster", "sign")).alias("b"))
        step = best.select("g", "b.i", "b.row", "b.t", "b.f", "b.cluster", "b.sign", F.lit(pos).alias("pos"))
        chosen = cut(step if chosen is None else chosen.unionByName(step))
    remove(spark, folder)
    return chosen.select(F.col("g").alias(group), F.col("i").alias(id_col), "pos")


def _weight(facet: Column, importance: dict[str, float] | None) -> Column:
    weight = F.lit(1.0)
    for name, w in (importance or {}).items():
        weight = F.when(facet == name, F.lit(float(w))).otherwise(weight)
    return weight


def overview(df: DataFrame, group: str, id_col: str, facet_col: str, n: int = 3) -> DataFrame:
    """W21 for each group: (group, pos, id): n rows spread over the group in id order; for each of n even places the
    row with most facets that none before it shows, then the nearest to the place, then the first.

    Places come from a range sort, and each step is a partially aggregated minimum: no group reaches one task whole.
    """
    rows = numbered(df.select(F.col(group).alias("g"), F.col(id_col).alias("i"), F.array_distinct(F.coalesce(F.col(facet_col), F.array())).alias("f")), ["g", "i"], "rn")
    size = rows.groupBy("g").agg(F.min("rn").alias("first"), F.count("*").alias("n")).withColumnRenamed("g", "of")
    rows = cut(rows.join(size, F.col("g").eqNullSafe(F.col("of"))).select("g", "i", "f", (F.col("rn") - F.col("first")).alias("j"), "n"))
    chosen = None
    for pos in range(n):
        now, fresh = rows, F.size("f")
        if chosen is not None:
            state = chosen.groupBy("g").agg(F.collect_list("j").alias("js"), F.array_distinct(F.flatten(F.collect_list("f"))).alias("seen")).withColumnRenamed("g", "of")
            few = chosen.count() <= BROADCAST_CHOSEN
            now = rows.join(F.broadcast(state) if few else state, F.col("g").eqNullSafe(F.col("of"))).where(~F.array_contains("js", F.col("j")))
            fresh = F.size(F.array_except("f", "seen"))
        total = F.least(F.lit(n), F.col("n"))
        place = F.floor((pos + 0.5) * F.col("n") / total)
        best = now.where(F.lit(pos) < total).groupBy("g").agg(F.min(F.struct((-fresh).alias("fresh"), F.abs(F.col("j") - place).alias("off"), "j", "i", "f")).alias("b"))
        step = best.select("g", "b.i", "b.j", "b.f", F.lit(pos + 1).alias("pos"))
        chosen = cut(step if chosen is None else chosen.unionByName(step))
    return chosen.select(F.col("g").alias(group), "pos", F.col("i").alias(id_col))


def enough(facet_col: Column, human: str, k: int) -> Column:
    """W22, as an aggregate: k rows, two facets besides the subject, and a human one."""
    kinds = F.array_distinct(F.flatten(F.collect_set(facet_col)))
    return (F.count("*") >= k) & (F.size(F.array_except(kinds, F.array(F.lit("subject")))) >= 2) & F.array_contains(kinds, human)
