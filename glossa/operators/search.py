"""Tiered full-text search of many queries at once, as one plan of equi-joins.

Postings are rows (key, order) and (gram, order), hash-partitioned by key; a batch of queries
is joined to them, tier by tier, and the tiers are ranked in one window a query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glossa.functions.text import grams
from glossa.session import paired


def postings(docs: DataFrame, order: str, keys: list[Column]) -> DataFrame:
    """Q01: distinct (ord, key) of a document's non-empty keys."""
    rows = docs.select(F.col(order).alias("ord"), F.explode(F.array_distinct(F.array(*keys))).alias("key"))
    return rows.where("key is not null and key <> ''").distinct()


def sorted_keys(posts: DataFrame) -> DataFrame:
    """Postings in runs of keys, as they are kept: a file's statistics tell which keys and prefixes it can hold."""
    return posts.repartitionByRange("key").sortWithinPartitions("key", "ord")


def gram_rows(posts: DataFrame) -> DataFrame:
    """(gram, df, ord, key) in runs of grams, as they are kept; df: in how many postings the gram stands."""
    rows = posts.select(F.explode(grams(F.col("key"))).alias("gram"), "ord", "key")
    df = rows.groupBy("gram").agg(F.count("*").alias("df"))
    return rows.join(df, "gram").repartitionByRange("gram").sortWithinPartitions("gram", "key", "ord")


def statistics(posts: DataFrame) -> DataFrame:
    """Numbers of terms, tokens, grams and postings, and the bytes of all terms, as one row."""
    terms = posts.select("key").distinct()
    one = terms.agg(F.count("*").alias("terms"), F.sum(F.octet_length("key")).cast("long").alias("bytes"))
    tokens = terms.select(F.explode(F.split("key", " ")).alias("t")).agg(F.count_distinct("t").alias("tokens"))
    g = terms.select(F.explode(grams(F.col("key"))).alias("g")).agg(F.count_distinct("g").alias("grams"))
    return one.crossJoin(tokens).crossJoin(g).crossJoin(posts.agg(F.count("*").alias("postings")))  # single rows


def exact(posts: DataFrame, queries: DataFrame) -> DataFrame:
    """Q02: (qid, ord) of documents that have the query as a key."""
    return queries.join(posts, F.col("key") == F.col("q")).select("qid", "ord").distinct()


def prefix(posts: DataFrame, queries: DataFrame, least: int = 3, cap: int | None = None) -> DataFrame:
    """Documents with a key that starts with the query.

    Joined on the first `least` characters, so no pair of unlike keys is formed; shorter queries
    are joined on one character. cap: only so many keys of a query, in key order (Q08).
    """
    long_, short = queries.where(F.length("q") >= least), queries.where((F.length("q") < least) & (F.length("q") > 0))

    def on(qs: DataFrame, n: int) -> DataFrame:
        keyed = posts.select("ord", "key", F.substring("key", 1, n).alias("head"))
        return qs.withColumn("head", F.substring("q", 1, n)).join(keyed, "head").where(F.startswith("key", "q")).select("qid", "q", "ord", "key")

    hits = on(long_, least).union(on(short, 1))
    if cap is not None:
        hits = hits.withColumn("rk", F.dense_rank().over(W.partitionBy("qid").orderBy("key"))).where(F.col("rk") <= cap)
    return hits.select("qid", "ord").distinct()


def substring(rows: DataFrame, queries: DataFrame) -> DataFrame:
    """Documents with a key that contains the query, for queries of three characters or more. rows: gram_rows().

    Only the rarest gram of a query is looked up; the keys found are verified.
    """
    long_ = queries.where(F.length("q") > 2)
    df = rows.groupBy("gram").agg(F.first("df").alias("df"))
    asked = long_.select("qid", "q", F.explode(grams(F.col("q"))).alias("gram")).join(df, "gram", "left")
    rarest = asked.groupBy("qid", "q").agg(F.min_by("gram", F.struct(F.coalesce("df", F.lit(0)), "gram")).alias("gram"))
    return rarest.join(rows, "gram").where(F.contains("key", "q")).select("qid", "ord").distinct()


def phrase(posts: DataFrame, queries: DataFrame) -> DataFrame:
    """Documents with a key that has all words of the query and contains it, but is not it."""
    words = posts.select("ord", "key", F.explode(F.array_distinct(F.split("key", " "))).alias("word"))
    asked = queries.select("qid", "q", F.explode(F.array_distinct(F.split("q", " "))).alias("word"), F.size(F.array_distinct(F.split("q", " "))).alias("n"))
    hits = asked.join(words, "word").groupBy("qid", "q", "n", "ord", "key").agg(F.count("*").alias("k"))
    return hits.where((F.col("k") == F.col("n")) & F.contains("key", "q") & (F.col("key") != F.col("q"))).select("qid", "ord").distinct()


def _cut_out(c: Column, i: Column) -> Column:
    """A term without its letter at place i."""
    return F.concat(F.substr(c, F.lit(1), i - 1), F.substr(c, i + 1))


def _tagged(tag: Column | str, c: Column) -> Column:
    return F.concat(F.lit(tag) if isinstance(tag, str) else tag.cast("string"), F.lit(":"), c)


def _places(c: Column, last: int = 0) -> Column:
    """The places of a term's letters, but for the last ones that are not wanted; none is an empty array."""
    n = F.length(c) - last
    return F.when(n > 0, F.sequence(F.lit(1), F.greatest(n, F.lit(1)))).otherwise(F.array().cast("array<int>"))


def near_keys(c: Column) -> Column:
    """What a term is found by: itself, each of its deletions, and each deletion with its place."""
    cuts = F.transform(_places(c), lambda i: _cut_out(c, i))
    own = F.transform(F.array_distinct(cuts), lambda x: _tagged("-", x))
    return F.concat(F.array(_tagged("=", c)), own, F.transform(cuts, lambda x, i: _tagged(i + 1, x)))


def near_asked(c: Column) -> Column:
    """What a query looks up in near_keys(): terms it becomes by a deletion or a swap, terms that become it by a deletion,
    and terms that are like it without the letter at one place. A term that it meets there is one edit away, or equal."""
    cuts = F.transform(_places(c), lambda i: _cut_out(c, i))
    swapped = F.transform(_places(c, 1), lambda i: F.concat(F.substr(c, F.lit(1), i - 1), F.substr(c, i + 1, F.lit(1)), F.substr(c, i, F.lit(1)), F.substr(c, i + 2)))
    made = F.array_distinct(F.concat(cuts, swapped))
    return F.concat(F.transform(made, lambda x: _tagged("=", x)), F.array(_tagged("-", c)), F.transform(cuts, lambda x, i: _tagged(i + 1, x)))


def near_rows(posts: DataFrame) -> DataFrame:
    """(near, key) of all distinct keys, in runs of near, as they are kept. One string stands for no more terms than there are letters that fit its place."""
    terms = posts.select("key").distinct()
    return terms.select(F.explode(near_keys(F.col("key"))).alias("near"), "key").repartitionByRange("near").sortWithinPartitions("near", "key")


def fuzzy(rows: DataFrame, posts: DataFrame, queries: DataFrame, least: int = 4) -> DataFrame:
    """Q09: documents with a key one edit from the query, for queries of `least` characters or more. rows: near_rows().

    An equi-join forms these pairs and, of others, only equal ones, whatever the number of keys; nothing large is broadcast.
    """
    asked = queries.where(F.length("q") >= least).select("qid", "q", F.explode(near_asked(F.col("q"))).alias("near"))
    close = paired(asked).join(rows, "near").where("q <> key").select("qid", "key")
    return close.hint("merge").join(posts, "key").select("qid", "ord").distinct()


def most_shared(posts: DataFrame, queries: DataFrame, most: int = 256) -> DataFrame:
    """(qid, key, shared, pos): the keys that share most grams with the query, `most` at most; of equals the first by key."""
    terms = posts.select("key").distinct()
    rows = terms.select("key", F.explode(grams(F.col("key"))).alias("gram"))
    asked = queries.select("qid", F.explode(grams(F.col("q"))).alias("gram"))
    shared = paired(asked).join(rows, "gram").groupBy("qid", "key").agg(F.count("*").alias("shared"))
    pos = F.row_number().over(W.partitionBy("qid").orderBy(F.desc("shared"), "key"))
    return shared.withColumn("pos", pos).where(F.col("pos") <= most)


def tiered(tiers: list[DataFrame], k: int) -> DataFrame:
    """(qid, ord, tier, pos): each document at its best tier, tiers in order, documents in order inside a tier, k at most."""
    rows = None
    for n, tier in enumerate(tiers):
        t = tier.select("qid", "ord", F.lit(n).alias("tier"))
        rows = t if rows is None else rows.union(t)
    best = rows.groupBy("qid", "ord").agg(F.min("tier").alias("tier"))
    pos = F.row_number().over(W.partitionBy("qid").orderBy("tier", "ord"))
    return best.withColumn("pos", pos).where(F.col("pos") <= k)


def interleave(first: DataFrame, second: DataFrame, limit: int, both: DataFrame | None = None) -> DataFrame:
    """Ranked lists (qid, id, rank, exact) and (qid, id, rank) merged; an id counts once.

    The first list, its exact matches before the others, keeps max(1, limit - min(size of the
    second, ceil(limit / 2))) leading slots; then come the second list and the rest of the first.
    For the queries (qid) of `both`, which are exact in the second list too, only exact matches
    of the first lead, and its others come last.
    """
    size = second.groupBy("qid").agg(F.count("*").alias("n2"))
    a = first.join(size, "qid", "left")
    a = a.withColumn("both", F.lit(False)) if both is None else a.join(both.select("qid", F.lit(True).alias("both")).distinct(), "qid", "left")
    slots = F.greatest(F.lit(1), F.lit(limit) - F.least(F.coalesce("n2", F.lit(0)), F.lit(-(-limit // 2))))
    last = F.coalesce("both", F.lit(False)) & ~F.col("exact")
    a = a.select("qid", "id", F.when(last, 3).when(F.col("rank") <= slots, 0).otherwise(2).alias("band"), "rank")
    rows = a.union(second.select("qid", "id", F.lit(1), "rank"))
    best = rows.groupBy("qid", "id").agg(F.min(F.struct("band", "rank")).alias("at"))
    return best.withColumn("pos", F.row_number().over(W.partitionBy("qid").orderBy("at", "id"))).where(F.col("pos") <= limit).select("qid", "id", "pos")


def shaped(hits: DataFrame, senses: DataFrame, language: str) -> DataFrame:
    """Q10: hits (qid, ord, key) with `matched_sense`, the first sense that has the key, and `matched_language`.

    senses: (ord, sense, key). A hit that no sense has keeps a null sense."""
    first = senses.groupBy("ord", "key").agg(F.min("sense").alias("matched_sense"))
    return hits.join(first, ["ord", "key"], "left").withColumn("matched_language", F.lit(language))


def early_exact(queries: DataFrame, core: DataFrame, rest: DataFrame, limit: int = 24) -> DataFrame:
    """Q12: (qid, id, pos): what may be shown before any other search has run: for queries that are Han throughout,
    entries (id, simplified, traditional) equal to them in either script, those of the core first, each id once."""
    han = queries.withColumn("q", F.trim("q")).where(F.col("q").rlike(r"^\p{IsHan}+$"))
    hits = None
    for side, entries in enumerate((core, rest)):
        keys = entries.select("id", F.explode(F.array_distinct(F.array("simplified", "traditional"))).alias("q"))
        one = han.join(keys, "q").select("qid", "id", F.lit(side).alias("side"))
        hits = one if hits is None else hits.union(one)
    best = hits.groupBy("qid", "id").agg(F.min("side").alias("side"))
    return best.withColumn("pos", F.row_number().over(W.partitionBy("qid").orderBy("side", "id"))).where(F.col("pos") <= limit).select("qid", "id", "pos")
