"""Iterative graph operators: connected components and transitive closure."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.session import cut, paired


#: Forest edges (two ids each) up to this many are settled by one task; more are by rounds over all tasks.
FEW_EDGES = 250_000
#: Edges that one task reduces to a forest.
TASK_EDGES = 500_000


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the edges of a partition, as many as tie the same nodes together: each node to the smallest of its tree."""
    parent: dict = {}

    def root(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            parent.setdefault(u, u)
            parent.setdefault(v, v)
            a, b = root(u), root(v)
            if a != b:
                parent[max(a, b)] = min(a, b)
    pairs = [(root(x), x) for x in parent]
    pairs = [p for p in pairs if p[0] != p[1]]
    for lo in range(0, len(pairs), 100_000):
        u, v = zip(*pairs[lo : lo + 100_000])
        yield pa.RecordBatch.from_arrays([pa.array(u, batch.schema.field(0).type), pa.array(v, batch.schema.field(1).type)], ["u", "v"])


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable over undirected edges.

    Partitions first reduce their edges to forests, so a dense group costs an edge a node.
    A small remainder is settled by one task. Else alternates the large-star and small-star steps, which move every edge towards the
    smallest neighbour; rounds grow with the logarithm of the diameter, each round is two
    shuffles of the remaining edges, and nothing but one boolean reaches the driver.
    Only nodes that appear in an edge are returned. A null end drops its edge.
    """
    e = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null")
    loops = e.where("u = v").select("u").distinct()
    e = e.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    kind = e.schema["u"].dataType.simpleString()
    e = cut(e)
    tasks = e.count() // TASK_EDGES + 1
    # dealt by both ends: a node that a third of all edges have is spread over all tasks
    e = cut(e.repartition(tasks, "u", "v").mapInArrow(_forest, f"u {kind}, v {kind}").distinct())
    nodes = e.select(F.col("u").alias("node")).union(e.select("v")).union(loops).distinct()
    if e.count() <= FEW_EDGES:
        tied = e.repartition(1).mapInArrow(_forest, f"u {kind}, v {kind}")
        return nodes.join(tied.select(F.col("v").alias("node"), F.col("u").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
    print_sum = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")
    seen = None
    for _ in range(max_rounds):
        # large star: every larger neighbour of a node is tied to the node's smallest neighbour
        both = e.union(e.select(F.col("v"), F.col("u")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("m").alias("u"), "v").where("u <> v").distinct()
        # small star: a node and its smaller neighbours are tied to the smallest of them
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(low, "v").select(F.col("m").alias("a"), "u").where("a <> u").select(F.col("a").alias("u"), F.col("u").alias("v"))
        e = cut(small.union(low.select(F.col("m").alias("u"), "v")).distinct())
        now = tuple(e.agg(F.count("*").alias("n"), print_sum).first())
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("connected components did not settle")
    best = e.groupBy(F.col("v").alias("node")).agg(F.min("u").alias("component"))
    return nodes.join(best, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def transitive_closure(edges: DataFrame, src: str, dst: str, max_rounds: int = 40) -> DataFrame:
    """(src, dst, distance): every ancestor a node reaches, with the fewest steps.

    A round doubles the distance: pairs exactly that far apart are joined to all pairs found, as a shortest path
    consists of both, so a pair is formed for each node halfway and cycles end. Rounds grow with the logarithm of the depth;
    max_rounds bounds the depth to 2**max_rounds.
    """
    base = edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).where("src is not null and dst is not null").distinct()
    found = cut(base.withColumn("distance", F.lit(1)))
    for k in range(max_rounds):
        ends = found.where(F.col("distance") == 1 << k).select("src", F.col("dst").alias("mid"), F.col("distance").alias("so_far"))
        if ends.isEmpty():
            return found
        steps = found.select(F.col("src").alias("mid"), "dst", "distance")
        reached = paired(ends).join(steps, "mid").select("src", "dst", (F.col("so_far") + F.col("distance")).alias("distance"))
        found = cut(found.unionByName(reached).groupBy("src", "dst").agg(F.min("distance").alias("distance")))
    raise RuntimeError("closure deeper than max_rounds")


def neighbourhood(seeds: DataFrame, edges: DataFrame, node: str, label: str, src: str, dst: str, most: int = 2, through: str | None = None) -> DataFrame:
    """(node, label, distance) of nodes within `most` steps of a seed (node, label), each with the label of the
    nearest seed, the smallest of equals. through: a boolean column of edges; beyond the first step only such edges count.

    Each step joins only the nodes found last and keeps a minimum a node, so it is bounded by nodes, not by paths.
    """
    e = edges.select(F.col(src).alias("node"), F.col(dst).alias("to"), (F.lit(True) if through is None else F.col(through)).alias("on"))
    found = cut(seeds.groupBy(F.col(node).alias("node")).agg(F.min(label).alias("label")).withColumn("distance", F.lit(0)))
    fresh = found
    for k in range(1, most + 1):
        steps = e if k == 1 else e.where("on")
        reached = paired(fresh).join(steps, "node").groupBy(F.col("to").alias("node")).agg(F.min("label").alias("label")).withColumn("distance", F.lit(k))
        fresh = cut(reached.join(found.hint("merge"), "node", "left_anti"))
        found = cut(found.unionByName(fresh))
    return found


def inherited(edges: DataFrame, marks: DataFrame, child: str, parent: str, node: str, mark: str, max_rounds: int = 200) -> DataFrame:
    """(node, mark): the marks that a node has itself or that any of its ancestors has, over parents of any number and depth.

    Marks move down from where they are set, a step a round, and only pairs not seen before move
    on, so cycles end, work is bounded by nodes times marks, and no pairs of nodes and ancestors are formed.
    """
    step = cut(edges.select(F.col(parent).alias("node"), F.col(child).alias("to")).where("node is not null and to is not null").distinct())
    found = cut(marks.select(F.col(node).alias("node"), F.col(mark).alias("mark"), F.lit(0).alias("round")).where("node is not null and mark is not null").distinct())
    for k in range(max_rounds):
        fresh = found.where(F.col("round") == k).select("node", "mark")
        if fresh.isEmpty():
            return found.select("node", "mark")
        moved = paired(fresh).join(step, "node").select(F.col("to").alias("node"), "mark", F.lit(k + 1).alias("round"))
        found = cut(found.unionByName(moved).groupBy("node", "mark").agg(F.min("round").alias("round")))
    raise RuntimeError("the hierarchy is deeper than max_rounds")


def categories(nodes: DataFrame, edges: DataFrame, marks: DataFrame, rules: DataFrame, veto: DataFrame, default: str) -> DataFrame:
    """(node, category): by the first rule (mark, priority, category) whose mark a node or an ancestor has, else its own
    `default` column; nodes that have a vetoed mark so are left out, as are those without any category.

    nodes: (node, default); edges: (child, parent); marks: (node, mark); veto: (mark). Only marks
    of rules and vetoes move through the graph, vetoes and rules together.
    """
    told = rules.select("mark", F.struct("priority", "category").alias("rule"), F.lit(False).alias("bars")).unionByName(veto.select("mark", F.lit(None).cast(rules.select(F.struct("priority", "category")).schema[0].dataType).alias("rule"), F.lit(True).alias("bars")))
    used = marks.join(F.broadcast(told.select("mark").distinct()), "mark", "left_semi")  # rule tables, of fixed size
    reached = inherited(edges, used, "child", "parent", "node", "mark").join(F.broadcast(told), "mark")
    best = reached.groupBy("node").agg(F.min("rule").alias("rule"), F.max("bars").alias("barred"))
    named = nodes.join(best.hint("merge"), "node", "left").where(~F.coalesce("barred", F.lit(False)))
    return named.select("node", F.coalesce("rule.category", F.col(default)).alias("category")).where("category is not null")
