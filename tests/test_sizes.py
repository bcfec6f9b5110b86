"""Plans that small files with large content must not change, and steps that must not grow faster than their input."""

from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from glossa import catalog, session
from glossa.functions import text
from glossa.operators import graph, qualify
from glossa.operators import search as s
from glossa.plans import events


def final_plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


@pytest.fixture()
def posts(spark, tmp_path):
    """Postings in a file of a few kilobytes, whose grams and deletions are many times that."""
    spark.range(4000).select(F.col("id").alias("ord"), F.format_string("customer#%09d", "id").alias("key")).coalesce(1).write.parquet(f"{tmp_path}/posts")
    return spark.read.parquet(f"{tmp_path}/posts")


def test_shared_grams_broadcast_the_queries_and_never_the_terms(spark, posts):
    got = s.most_shared(posts, spark.createDataFrame([(1, "customer#000000012")], "qid int, q string"), 3)
    assert [(r.key, r.pos) for r in sorted(got.collect(), key=lambda r: r.pos)] == [("customer#000000012", 1), ("customer#000000120", 2), ("customer#000000121", 3)]
    assert "BuildLeft" in final_plan(got) and "BuildRight" not in final_plan(got)


def test_shared_grams_of_many_queries_broadcast_nothing(spark, posts, monkeypatch):
    asked = spark.createDataFrame([(1, "customer#000000012"), (2, "zzcustoxx")], "qid int, q string")
    want = sorted(map(tuple, s.most_shared(posts, asked, 5).collect()))
    monkeypatch.setattr(session, "FEW_ROWS", 3)
    got = s.most_shared(posts, asked, 5)
    assert sorted(map(tuple, got.collect())) == want and len(want) == 10
    assert "Broadcast" not in final_plan(got)


def test_fuzzy_of_all_terms_broadcasts_nothing_and_forms_only_near_pairs(spark, posts):
    rows = s.near_rows(posts)
    asked = posts.select(F.col("ord").alias("qid"), F.col("key").alias("q"))
    got = s.fuzzy(rows, posts, asked)
    n = got.count()
    near = lambda a, b: a != b and (sum(x != y for x, y in zip(a, b)) == 1 or any(a[:i] + a[i + 1] + a[i] + a[i + 2 :] == b for i in range(3)))
    some = random.Random(1).sample(range(4000), 20)
    want = sum(near(f"{a:04d}", f"{b:04d}") for a in some for b in range(4000))
    assert got.where(F.col("qid").isin(some)).count() == want
    got.collect()
    assert "Broadcast" not in final_plan(got)
    asked_rows = asked.select("qid", "q", F.explode(s.near_asked(F.col("q"))).alias("near"))
    assert asked_rows.join(rows, "near").where("q <> key").count() == n


def shortest(edges):
    """(src, dst): steps, by a walk from every node."""
    after, out = {}, {}
    for a, b in edges:
        after.setdefault(a, set()).add(b)
    for a in after:
        reached, step = after[a], 1
        while reached:
            out |= {(a, b): step for b in reached if (a, b) not in out}
            reached, step = {c for b in reached for c in after.get(b, ())} - {b for x, b in out if x == a}, step + 1
    return out


@pytest.mark.parametrize("few", [0, 10_000])
def test_closure_of_random_graphs_has_the_fewest_steps(spark, monkeypatch, few):
    monkeypatch.setattr(session, "FEW_ROWS", few)
    rng = random.Random(3)
    edges = [(rng.randrange(40), rng.randrange(40)) for _ in range(55)] + [(k, k + 1) for k in range(100, 170)] + [(170, 150), (None, 1)]
    got = graph.transitive_closure(spark.createDataFrame(edges, "a int, b int"), "a", "b", max_rounds=8)  # a chain of 70 steps
    assert {(r.src, r.dst): r.distance for r in got.collect()} == shortest([e for e in edges if None not in e])


def test_rounds_of_graphs_broadcast_only_small_frontiers(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "FEW_ROWS", 5)
    plans, cut = [], graph.cut

    def watched(df):
        out = cut(df)
        plans.append(final_plan(df))
        return out

    monkeypatch.setattr(graph, "cut", watched)
    spark.range(1, 400).selectExpr("id as a", "id div 2 as b").coalesce(1).write.parquet(f"{tmp_path}/e")
    e = spark.read.parquet(f"{tmp_path}/e")
    assert graph.transitive_closure(e, "a", "b").count() == sum(n.bit_length() for n in range(1, 400))
    marks = e.where("a <= 300").selectExpr("a", "a % 7 as m")
    got = graph.inherited(e, marks, "a", "b", "a", "m")
    want = set()
    for n in range(1, 400):
        x = n
        while x:
            want |= {(n, x % 7)} if x <= 300 else set()
            x //= 2
    assert {tuple(r) for r in got.collect()} == want
    assert not any("Broadcast" in p for p in plans if "SortMergeJoin" in p) and sum("SortMergeJoin" in p for p in plans) >= 8


@pytest.mark.parametrize("name", ["quality_concordance", "quality_recovery"])
def test_costly_rules_are_dealt_over_tasks_and_computed_once(spark, name):
    df = catalog.queries()[name](spark, "/root/testdata/sf0.001")
    assert df.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count(r"[^\p{L}\p{N}]+") <= 2


def test_qualification_of_odd_outputs(spark):
    none = F.array().cast("array<string>")
    rows = [(None, None, None), ("", "g", False), ("Ä; ä ;a;", "g", False), ("untuk ;untuk X", "g", None), ("ﬁ；Ｘ", "fig. g", False)]
    df = spark.createDataFrame(rows, "o string, g string, i boolean")
    codes = qualify.output_evidence(F.col("o"), F.lit(True), F.col("g"), F.lit("v"), F.col("i"), F.array(F.lit("A")), F.lit(False), F.array(F.lit("x")), none, none)
    got = [(list(r.c or []), r.e) for r in df.select(codes.alias("c"), qualify.equivalents(F.col("o")).alias("e")).collect()]
    assert got == [
        ([], None), (["non-lexical-symbols-or-script", "empty"], []), (["bare-verb-needs-review"], ["Ä"]), (["whole-output-reference-mismatch", "malaysian-scope-review", "bare-verb-needs-review"], ["untuk", "X"]),
        (["non-lexical-symbols-or-script", "special-sense-needs-context-review", "whole-output-reference-mismatch"], ["ﬁ；Ｘ"]),
    ]


def test_parentheses_cost_what_the_text_is_long(spark):
    # deep ones and many, which once copied all that was kept for each of them
    deep, wide = "a(" * 20_000 + ")" * 19_999, "x (y) " * 20_000
    df = spark.createDataFrame([(0, deep), (1, wide), (2, "a ) b ( c (d) e"), (3, None), (4, "((()"), (5, ")(")], "i int, s string")
    begun = time.monotonic()
    got = {r.i: r.p for r in df.select("i", text.without_parentheses(F.col("s")).alias("p")).collect()}
    assert got == {0: "a(a", 1: " ".join("x" * 20_000), 2: "a ) b ( c e", 3: "", 4: "((", 5: ")("}
    assert time.monotonic() - begun < 30


def test_batches_of_ordered_lines_are_written_by_all_tasks(spark, monkeypatch):
    folders, seen = set(), events.streams.run_available

    def watched(df, folder):
        folders.add(folder)
        return seen(df, folder=folder)

    monkeypatch.setattr(events.streams, "run_available", watched)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        catalog.queries()["stream_ordered_lines"](spark, "/root/testdata/sf0.001")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    (folder,) = folders
    assert len(spark.read.parquet(f"{folder}/in").inputFiles()) > 3
