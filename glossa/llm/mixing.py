"""Operator 8: mixing sources to target weights, with DataFrame functions only.

A time-varying curriculum. The mix runs over training time t in [0, 1]. Every source has a
linear weight schedule w_s(t) = 1 + drift_s * (2t - 1), whose integral W_s(t) says what part
of the source's demand, its target, is used up by t. The demand walks through the source's
documents in the order of a digest of their ids, again from the first when it has seen all; a
document that begins after u words of demand is due at W_s^-1(u / target), in closed form.
Documents are then range-sorted by position.

Targets: a source's share of `share` times all words goes by weight, stops at `most` times
its own words, and the excess is shared again by weight until no source is above; that
fixed point is found by one pass over the sources sorted by cap per weight.

Scale: prefix sums are two-level (blocks of a source by digest, then inside a block), so a
source that holds a third of all rows is spread over as many windows as it has blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glossa.session import cut

WEIGHTS = (5, 2, 1)
#: The table of sources, about 60 bytes a row, is broadcast up to this many; beyond it, it is joined by a shuffle.
BROADCAST_SOURCES = 100_000


def word_count(text: Column) -> Column:
    """Number of runs of characters other than space and \\x09-\\x0D (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, source: str = "source", share: float = 1.5, most: int = 2, weights=WEIGHTS) -> DataFrame:
    """(source, source_size, ordinal, target) from one row (source, source_size) for each source.

    Sources rank by code point, null last. A source without words gets target 0.
    """
    by_name = W.orderBy(F.col(source).asc_nulls_last())
    ranked = sizes.withColumn("ordinal", F.row_number().over(by_name) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("ordinal") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("weight", weight).withColumn("cap", (F.col("source_size") * most).cast("double"))
    order = [(F.col("cap") / F.col("weight")).asc(), F.col("ordinal").asc()]
    before = W.orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    after = W.orderBy(*order).rowsBetween(W.currentRow, W.unboundedFollowing)
    everything = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    # with the sources before a row held at their caps, the level each unit of weight from this row on gets
    level = (F.lit(share) * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    fits = ranked.withColumn("level", level).withColumn("free", F.col("level") * F.col("weight") <= F.col("cap"))
    # the first source, by cap per weight, that its level does not fill: it and all after it get that level
    first = F.min(F.when(F.col("free"), F.struct(F.col("cap") / F.col("weight"), "ordinal", "level"))).over(everything)["level"]
    return fits.withColumn("target", F.least(F.col("cap"), F.coalesce(first, F.col("cap")) * F.col("weight"))).withColumn(
        "target", F.when(F.col("source_size") > 0, F.col("target")).otherwise(0.0)
    ).select(source, "source_size", "ordinal", "target")


def mix(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", share: float = 1.5, most: int = 2,
        weights=WEIGHTS, block_rows: int = 2_000, extra: tuple[str, ...] = (), ties: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, copies, position, and `extra` columns.

    taken: the words that the mix takes of the document, at most `most` times its size. If it
    covers the words [a, b) of its source of S words, these are the words of [a, b), [a + S,
    b + S), ... below the rounded target: a source's taken words sum to that exactly, and at
    most one document of a source is taken in part. copies: how many times the document is
    started; position: when its first word falls (null: it takes nothing). Null or empty text:
    size 0, taken 0. Repeated rows count each for itself; rows equal in id and size are
    interchangeable, so reruns agree; `ties`, columns among extra, order them. An empty table gives no rows.
    """
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source).alias("__source"), word_count(F.col(text)).alias("size"),
        F.sha2(F.concat_ws("|", F.lit("mix"), F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("null "), F.xxhash64(text).cast("string")))), 256).alias("__digest"), *[F.col(c) for c in extra],
    )
    rows = rows if extra else cut(rows)  # the words of a text are counted once; what travels with the rows is not written for that
    counted = rows.groupBy("__source").agg(F.sum("size").alias("source_size"), F.count("*").alias("__n"))
    targets = source_targets(counted.select("__source", "source_size"), "__source", share, most, weights)
    # blocks per source follow its own rows; a block is a run of the first 32 bits of the digest
    plan = targets.join(counted.select(F.col("__source").alias("__s"), "__n"), F.col("__source").eqNullSafe(F.col("__s"))).select(
        "__source", "source_size", "ordinal", "target", F.ceil(F.col("__n") / block_rows).alias("__blocks"))
    plan = cut(plan.withColumnRenamed("__source", "__s"))
    few = plan.count() <= BROADCAST_SOURCES
    keyed = rows.join(F.broadcast(plan) if few else plan, F.col("__source").eqNullSafe(F.col("__s")))
    head = F.conv(F.substring("__digest", 1, 8), 16, 10).cast("long")
    keyed = keyed.drop("__s", "__source").withColumn("__block", F.floor(head * F.col("__blocks") / F.lit(1 << 32)).cast("long"))
    sums = keyed.groupBy("ordinal", "__block").agg(F.sum("size").alias("__size"))
    upto = W.partitionBy("ordinal").orderBy("__block").rowsBetween(W.unboundedPreceding, -1)
    starts = sums.select(F.col("ordinal").alias("__o"), F.col("__block").alias("__b"), F.coalesce(F.sum("__size").over(upto), F.lit(0)).alias("__start"))
    inside = W.partitionBy("ordinal", "__block").orderBy("__digest", "size", *ties).rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = keyed.withColumn("__in", F.sum("size").over(inside)).join(starts, (F.col("ordinal") == F.col("__o")) & (F.col("__block") == F.col("__b")))
    begin = F.col("__start") + F.col("__in") - F.col("size")
    goal = F.round("target").cast("long")
    left = [goal - F.col("source_size") * j - begin for j in range(most)]
    taken = sum((F.greatest(F.lit(0), F.least(F.col("size"), x)) for x in left), F.lit(0)).cast("long")
    started = sum((((x > 0) & (F.col("size") > 0)).cast("int") for x in left), F.lit(0)).cast("int")
    out = placed.withColumn("taken", taken).withColumn("copies", started)
    return out.select("doc_id", "size", "source_size", "target", "taken", "copies", F.when(F.col("copies") > 0, due(begin / goal)).alias("position"),
                      F.col("ordinal").alias("source_ordinal"), begin.cast("long").alias("begin"), *extra)


def due(u: Column) -> Column:
    """W_s^-1 of a part of a source's demand: W_s(t) = t + d (t^2 - t), with drift d in (-1, 1) by the source's ordinal."""
    d = (F.col("ordinal") % 3 - 1) * 0.5
    return F.when(d == 0, u).otherwise(F.abs((d - 1 + F.sqrt((1 - d) * (1 - d) + 4 * d * u)) / (2 * d)))  # abs: no negative zero


def in_order(rows: DataFrame, position: str = "position", tie: str = "doc_id") -> DataFrame:
    """Rows range-sorted by a position in [0, 1] (null last). Positions spread words evenly, so ranges need no sampling."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = F.least(F.lit(n - 1), F.floor(F.coalesce(F.col(position), F.lit(1.0)) * n)).cast("int")
    # rows without a position would all be last: they are spread, as they have no order
    part = F.when(F.col(position).isNull(), F.pmod(F.xxhash64(tie), F.lit(n)).cast("int")).otherwise(part)
    return rows.repartitionById(n, part).sortWithinPartitions(F.col(position).asc_nulls_last(), tie)


def curriculum(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The mix itself: the rows of docs, all columns, each as often as it is started, in training order.

    Documents that the mix takes nothing of are left out; one taken in part is given whole. The
    documents' columns travel through the mix, so rows of a null or a repeated id are rows like
    all others: each has its own copies, at most `most`. Rows equal in id and size go by text.
    """
    row, tie = F.struct(*[F.col(c) for c in docs.columns]), F.xxhash64(text)
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text).alias("__text"), F.col(source).alias("__from"), row.alias("__row"), tie.alias("__tie"))
    plan = mix(rows, "__id", "__text", "__from", extra=("__row", "__tie"), ties=("__tie",), **options).where("copies > 0")
    plan = plan.select("*", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("__copy"), F.col("source_ordinal").alias("ordinal"))
    at = due((F.col("begin") + F.col("source_size") * F.col("__copy")) / F.round("target").cast("long"))
    return in_order(plan.select("__row", F.col("doc_id").alias("__id"), at.alias("__position")), "__position", "__id").select("__row.*")


ORACLE = r"""
WITH rows AS (
  SELECT doc_id, source, CAST(COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         sha256('mix|' || CAST(doc_id AS VARCHAR)) AS digest
  FROM documents),
counted AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM rows GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS ordinal FROM counted),
weighed AS (SELECT *, CASE ordinal % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, CAST(source_size * 2 AS DOUBLE) AS cap FROM ranked),
leveled AS (
  SELECT *, (1.5::DOUBLE * CAST(sum(source_size) OVER () AS DOUBLE) - COALESCE(sum(cap) OVER (ORDER BY cap / weight, ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
         / sum(weight) OVER (ORDER BY cap / weight, ordinal ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed),
targets AS (
  SELECT source, source_size, ordinal, CASE WHEN source_size > 0 THEN least(cap, COALESCE((SELECT level FROM leveled WHERE level * weight <= cap ORDER BY cap / weight, ordinal LIMIT 1), 1e300) * weight) ELSE 0.0 END AS target FROM leveled),
placed AS (
  SELECT doc_id, size, source_size, ordinal, target, CAST(round(target) AS BIGINT) AS goal,
         CAST(sum(size) OVER (PARTITION BY ordinal ORDER BY digest, size ROWS UNBOUNDED PRECEDING) AS BIGINT) - size AS a
  FROM rows r JOIN targets t ON r.source IS NOT DISTINCT FROM t.source),
cut AS (
  SELECT *, greatest(0, least(size, goal - a)) + greatest(0, least(size, goal - source_size - a)) AS taken,
         CASE WHEN size > 0 THEN CAST(goal > a AS INTEGER) + CAST(goal - source_size > a AS INTEGER) ELSE 0 END AS copies,
         CASE WHEN goal > 0 THEN a / CAST(goal AS DOUBLE) END AS u, (ordinal % 3 - 1) * 0.5::DOUBLE AS d
  FROM placed)
SELECT doc_id, size, source_size, target, CAST(taken AS BIGINT) AS taken, CAST(copies AS INTEGER) AS copies,
       CASE WHEN copies > 0 THEN round(CASE WHEN d = 0 THEN u ELSE abs((d - 1 + sqrt((1 - d) * (1 - d) + 4 * d * u)) / (2 * d)) END, 9) END AS position
FROM cut
"""


def query(spark, sf_dir):
    """op8: mixes all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return in_order(mix(docs)).withColumn("position", F.round("position", 9)).drop("source_ordinal", "begin")
