"""Operators against brute force and their own laws."""

from __future__ import annotations

import io
import json
import random
import tarfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from glossa.operators import graph, inference, joins, quality, rank, sample, selection, store, validate, versions
from glossa.sources import ranges, readers
from glossa.streaming import folds, streams


@pytest.mark.parametrize("few", [0, 1000])
def test_connected_components_match_union_find(spark, monkeypatch, few):
    monkeypatch.setattr(graph, "FEW_EDGES", few)
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(7, 7), (None, 3)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    got = graph.connected_components(spark.createDataFrame(edges, "a int, b int"), "a", "b").collect()
    assert {r.node: r.component for r in got} == {x: root(x) for x in parent}


def test_components_of_no_edges(spark):
    assert graph.connected_components(spark.createDataFrame([], "a int, b int"), "a", "b").count() == 0


def test_closure_ends_on_cycles(spark):
    got = graph.transitive_closure(spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "a int, b int"), "a", "b")
    assert {(r.src, r.dst): r.distance for r in got.collect()}[(1, 1)] == 3


def test_divide_wants_every_member(spark):
    pairs = spark.createDataFrame([("x", 1), ("x", 2), ("y", 1), ("z", 1), ("z", 2), ("z", 3)], "g string, m int")
    want = spark.createDataFrame([("q", 1), ("q", 2), ("q", 2), ("r", 9)], "need string, m int")
    assert sorted(map(tuple, joins.divide(pairs, "g", "m", want).collect())) == [("q", "x"), ("q", "z")]


def test_upsert_protects_verified_rows(spark):
    base = spark.createDataFrame([(1, True, "a"), (2, False, "b")], "k int, ok boolean, v string")
    out = store.protected_upsert(base, spark.createDataFrame([(2, True, "c"), (3, False, "d")], base.schema), ["k"], "ok", ["v"])
    assert sorted(map(tuple, out.collect())) == [(1, True, "a"), (2, True, "c"), (3, False, "d")]
    with pytest.raises(ValueError, match="verified"):
        store.protected_upsert(base, spark.createDataFrame([(1, True, "z")], base.schema), ["k"], "ok", ["v"])
    with pytest.raises(ValueError, match="twice"):
        store.protected_upsert(base, spark.createDataFrame([(5, True, "z"), (5, True, "y")], base.schema), ["k"], "ok", ["v"])


def test_publish_is_idempotent_and_keys_are_unique(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    one = store.publish(df, str(tmp_path), ["k"])
    assert store.publish(df.repartition(3), str(tmp_path), ["k"]) == one == store.current(spark, str(tmp_path))
    with pytest.raises(ValueError, match="unique"):
        store.publish(df.union(df), str(tmp_path), ["k"])
    assert store.load(spark, str(tmp_path)).count() == 2


def test_numbered_is_a_total_order(spark):
    df = spark.range(1000).repartition(7).select((F.col("id") * 37 % 1000).alias("x"))
    got = sample.numbered(df, ["x"], buckets=5).collect()
    assert sorted((r.x, r.rn) for r in got) == [(i, i + 1) for i in range(1000)]


def brute_gallery(rows, k, importance, scenes):
    """Positions in the order chosen; rows: (score, facets, terms, symbolic, human), sorted by score and id."""
    cluster = ["symbol" if s else "+".join(sorted(f)) if f else "human-subject" if h else "subject" for _, f, _, s, h in rows]
    best = max(0, *[r[0] for r in rows])
    several = len({c for c, r in zip(cluster, rows) if r[0] >= best - 110}) >= 2
    has_scenes = scenes and any(h and not s for _, _, _, s, h in rows)
    left, chosen = list(range(len(rows))), []
    while left and len(chosen) < k:
        symbols = sum("symbol" in rows[j][1] for j in chosen)
        if has_scenes and symbols:
            left = [i for i in left if not rows[i][3]]
        if several:
            left = [i for i in left if sum(cluster[j] == cluster[i] and set(rows[j][2]) == set(rows[i][2]) for j in chosen) < 2]
        if not left:
            break
        seen = {f for j in chosen for f in rows[j][1]}

        def worth(i):
            score, facets, terms, symbolic, human = rows[i]
            r = sum(cluster[j] == cluster[i] for j in chosen)
            alike = max((len(set(terms) & set(rows[j][2])) / max(1, len(set(terms) | set(rows[j][2]))) for j in chosen), default=0)
            gain = sum(38 * importance.get(f, 1) for f in set(facets) - seen)
            return score + gain + (30 if scenes and human and not symbolic else 0) - min(180, 18 * r + 3 * r * r) - 30 * alike - (120 * symbols if symbolic else 0)

        at = max(left, key=lambda i: (round(worth(i), 9), -i))
        chosen.append(at)
        left.remove(at)
    return chosen


@pytest.mark.parametrize("scenes", [False, True])
def test_diverse_top_matches_the_definition(spark, scenes):
    rng = random.Random(3)
    rows = sorted(((float(rng.randrange(0, 150, 5)), rng.sample(["a", "b", "symbol"], rng.randint(0, 2)), rng.sample("uvwxyz", rng.randint(0, 2)), rng.random() < 0.3, rng.random() < 0.4) for _ in range(40)), key=lambda r: -r[0])
    df = spark.createDataFrame([("g", i, *r) for i, r in enumerate(rows)], "g string, id int, score double, facets array<string>, terms array<string>, s boolean, h boolean")
    got = rank.diverse_top(df, "g", "id", "score", "facets", "terms", 12, F.col("s"), F.col("h"), {"a": 2.0}, scenes).orderBy("pos").collect()
    assert [r.id for r in got] == brute_gallery(rows, 12, {"a": 2.0}, scenes)


@pytest.mark.parametrize("capacity, ttl", [(3, 50), (100, 20), (1, 1000)])
def test_fifo_cache(spark, capacity, ttl):
    rng = random.Random(5)
    events = [("cd"[rng.randrange(2)], rng.randrange(8), t, t, rng.random() < 0.2) for t in range(0, 300, 3)]
    df = spark.createDataFrame(events, "cache string, key int, ms long, id long, bad boolean")
    got = {r.id: r.hit for r in folds.fifo_cache(df, "cache", "key", "ms", "id", capacity, ttl, "bad", 5).collect()}
    for name in "cd":
        line: list[tuple[int, int]] = []  # (key, expires), first in first
        for c, k, t, i, bad in events:
            if c == name:
                hit = any(x == k and until > t for x, until in line)
                assert got[i] == hit
                if not hit:
                    line = [(x, until) for x, until in line if x != k] + [(k, t + (5 if bad else ttl))]
                    line = line[-capacity:]


def test_cooldown_waits_as_asked(spark):
    rows = spark.createDataFrame([(429, 5), (429, 700), (429, 10**7), (429, None), (401, 9), (500, 9)], "s int, r int")
    assert [r.w for r in rows.select(folds.cooldown_millis(F.col("s"), F.col("r")).alias("w")).collect()] == [60000, 700000, 86400000, 60000, 60000, None]


def test_diverse_top_weighs_all_rows_of_a_group(spark):
    # 300 rows share the top score; rows of a lower one bring new facets
    rows = [("a", i, 9.0, ["p"], [f"t{i % 150}", f"u{i % 7}"]) for i in range(300)] + [("a", 300 + i, 5.0, [f"f{i}", "p"], [f"v{i}"]) for i in range(4)] + [(None, 1, 2.0, [], [])]
    df = spark.createDataFrame(rows, "g string, id long, score double, facets array<string>, terms array<string>")
    got = [(r.g, r.id) for r in sorted(rank.diverse_top(df, "g", "id", "score", "facets", "terms", k=4).collect(), key=lambda r: (r.g is None, r.pos))]
    order = brute_gallery([(*r[2:], False, False) for r in rows[:-1]], 4, {}, False)
    assert got == [("a", i) for i in order] + [(None, 1)]
    assert any(i >= 300 for i in order)


def test_bisect_isolates_the_row_at_fault():
    def run(batch):
        if "bad" in batch:
            raise ValueError("no")
        return [x.upper() for x in batch]

    assert inference.bisect(run, ["a", "b", "bad", "c"], tries=1) == [("A", None, 1), ("B", None, 1), (None, "ValueError: no", 1), ("C", None, 1)]


def test_failures_are_tried_again_after_longer_pauses():
    pauses, left = [], [2]

    def run(batch):
        if left[0]:
            left[0] -= 1
            raise ValueError("not now")
        return batch

    assert inference.attempt(run, ["a"], sleep=pauses.append) == (["a"], 3) and pauses == [0.25, 0.5]
    asked = []

    def barred(batch):
        asked.append(batch)
        raise inference.PolicyError("barred")

    assert inference.bisect(barred, ["a", "b"], sleep=pauses.append) == [(None, "PolicyError: barred", 1)] * 2 and len(asked) == 1
    assert inference.bisect(lambda batch: [], ["a"], sleep=lambda s: None)[0][1].startswith("ValueError")


def test_batches_shrink_with_memory():
    assert [inference.batch_size(m * inference.MIB, 64) for m in (100, 599, 600, 999, 1000)] == [8, 8, 24, 24, 64] and inference.batch_size(10**12, 5) == 5


def test_anchored_windows_match_a_walk(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(4), i, rng.randrange(400)) for i in range(300)]
    df = spark.createDataFrame(rows, "k long, id long, ms long")
    for inclusive in (True, False):
        want, state = {}, {}
        for k, i, ms in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
            a, n = state.get(k, (None, 0))
            if a is None or (ms > a + 60 if inclusive else ms >= a + 60):
                a, n = ms, 0
            state[k] = (a, n + 1)
            want[i] = state[k]
        got = folds.anchored_windows(df, "k", "ms", "id", 60, inclusive).collect()
        assert {r.id: (r.anchor, r.nth) for r in got} == want


def test_cooldown(spark):
    rows = [(1, 1, 0, True), (1, 2, 50, True), (1, 3, 100, False), (2, 4, 10, False)]
    df = spark.createDataFrame(rows, "k long, id long, ms long, bad boolean").withColumn("wait", F.lit(100).cast("long"))
    assert {r.id: r.skipped for r in folds.cooldown(df, "k", "ms", "id", "bad", "wait").collect()} == {1: False, 2: True, 3: False, 4: False}


def test_lines_leave_out_repeats_and_end_once(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "x"), ("a", 3, "y"), ("a", 4, "y"), ("b", 1, None)], "s string, i int, r string")
    got = [(r.s, r.i, r.line) for r in folds.to_lines(df, "s", "i", "r").orderBy("s", "i").collect()]
    assert got == [("a", 1, '{"result":"x","done":false}'), ("a", 3, '{"result":"y","done":false}'), ("a", 4, '{"result":"y","done":true}'), ("b", 1, '{"result":null,"done":true}')]


@pytest.mark.parametrize(("lines", "want"), [(['{"done":false}', '{"result":"x","done":true}'], (None, "x")), (['{"done":false}'], ("no-final", None)), (['{"done":true}', '{"done":true}'], ("after-final", None)), (["{"], ("malformed", None)), (['{"done":true}' + " " * 90], ("oversized", None))])
def test_check_lines(spark, lines, want):
    df = spark.createDataFrame([("s", i, line) for i, line in enumerate(lines)], "s string, i int, line string")
    assert [(r.error, r.result) for r in folds.check_lines(df, "s", "i", "line", 100).collect()] == [want]


def test_structured_content(spark):
    good = '{"word":"w","sentences":[{"text":"w a"},{"text":"w b"},{"text":"w c"}]}'
    df = spark.createDataFrame([(good,), (good.replace("w c", "W, A!"),), ('{"word":"w"}',)], "c string")
    assert [r[0] for r in df.select(validate.sentences_verdict(F.col("c"), F.lit("w"))).collect()] == ["valid", "duplicate", "keys"]


def test_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_text('english,malay\r\n"say ""hi""","kata\nhai"\r\nonly\r\n', newline="")
    rows = readers.read_any(spark, str(tmp_path / "a.csv"), "english string, malay string").collect()
    assert rows[0].english == 'say "hi"' and rows[0].malay == "kata\nhai" and rows[1].malformed is not None
    (tmp_path / "a.jsonl").write_text('{"x": 1}\n\n{bad\n{"x": 2}\n')
    assert [(r.row and r.row.x, r.error) for r in readers.read_any(spark, str(tmp_path / "a.jsonl"), "x int").collect()] == [(1, None), (None, "malformed-json"), (2, None)]
    (tmp_path / "b.json").write_text('[{"x": 1}, {"x": 2')
    with pytest.raises(Exception):
        readers.read_any(spark, str(tmp_path / "b.json"), "x int").collect()
    with pytest.raises(ValueError, match="unsupported"):
        readers.read_any(spark, "a.bin", "x int")


def test_tar_members(spark, tmp_path):
    import io
    import tarfile

    with tarfile.open(tmp_path / "a.tar", "w") as t:
        info = tarfile.TarInfo("dict/x.txt")
        info.size = 3
        t.addfile(info, io.BytesIO(b"abc"))
    assert [(r.member, bytes(r.content)) for r in readers.tar_members(spark.read.format("binaryFile").load(str(tmp_path / "a.tar"))).collect()] == [("dict/x.txt", b"abc")]


def test_batches_are_accepted_whole_or_not_at_all(spark):
    df = spark.createDataFrame([("a", 1), ("a", 9), ("b", 2), (None, 3), (None, 4)], "g string, x int")
    found = quality.issues({"big": F.col("x") > 5})
    assert sorted(r.x for r in quality.accept_batches(df, "g", found).collect()) == [2, 3, 4]
    assert quality.accept_batches(df, "g", quality.issues({"three": F.col("x") == 3})).where("g is null").count() == 0


def test_json_arrays(spark, tmp_path):
    def read(text, **how):
        (tmp_path / "a.json").write_text(text, encoding="utf-8")
        return [(r.row.a if r.row else None, r.error) for r in readers.read_json_array(spark, str(tmp_path / "a.json"), "a string", **how).collect()]

    assert read('﻿ [ {"a": "x, ]"} , {"a": "\\"[{"} ,\n{"a": null}]  ') == [("x, ]", None), ('"[{', None), (None, None)]
    assert read("[]") == [] and read('[{"a":"x"},{"a" "y"}]') == [("x", None), (None, "malformed-json")]
    assert read('[{"a":"' + "y" * 50 + '"},{"a":"x"}]', most=30) == [(None, "oversized-record"), ("x", None)]
    for bad in ('[{"a":"x"}', '[{"a":"x"}] y', '{"a":"x"}'):
        with pytest.raises(Exception, match="JSON array"):
            read(bad)


def test_snapshots_restore_what_was_written(spark):
    df = spark.createDataFrame([(i, f"v{i % 3}") for i in range(300)], "k long, v string")
    planned = store.snapshots(df, ["k"], 128).cache()
    assert sorted((r.batch, r.records) for r in planned.collect()) == [(0, 128), (1, 128), (2, 44)]
    back = readers.restore(planned, "k long, v string", "k", 300)
    assert [tuple(r) for r in back.orderBy("k").select("batch", "k", "v").collect()] == [(i // 128, i, f"v{i % 3}") for i in range(300)]
    assert [r.batch for r in store.resume(planned.where("batch < 2"), planned).collect()] == [2]
    for broken in (planned.where("batch <> 1"), planned.withColumn("sha256", F.lit("x")), planned.union(planned.where("batch = 0"))):
        with pytest.raises(ValueError, match="snapshot|checkpoint"):
            readers.restore(broken, "k long, v string", "k", 300)
    with pytest.raises(ValueError, match="differs"):
        store.resume(planned.withColumn("sha256", F.lit("x")), planned)


def test_neighbourhood(spark):
    seeds = spark.createDataFrame([("a", "L"), ("z", "K")], "n string, l string")
    edges = spark.createDataFrame([("a", "b", False), ("b", "c", True), ("b", "d", False), ("z", "b", True), ("c", "e", True), ("b", "a", True)], "s string, t string, on boolean")
    got = {r.node: (r.label, r.distance) for r in graph.neighbourhood(seeds, edges, "n", "l", "s", "t", 2, "on").collect()}
    assert got == {"a": ("L", 0), "z": ("K", 0), "b": ("K", 1), "c": ("K", 2)}


def test_references_need_every_sense_to_agree(spark):
    """Random mentions, senses and seeds, with nulls and repeats, against a walk."""
    import random

    from glossa.operators import references as x

    rng = random.Random(5)
    senses = [(rng.choice("abcdefgh"), k % 40) for k in range(60)] + [("a", 0), ("a", 0), (None, 3)]
    seed = [(k, rng.choice(["x; y", "Y;x", "z", None]), rng.choice(["n", "n", None])) for k in range(36)] + [(0, "x; y", "n"), (99, "x", "n")]
    rows = [(k, [(rng.choice(["variant", "see", "also-written"]), rng.choice([*"abcdefghij", None])) for _ in range(rng.randint(0, 3))]) for k in range(40)] + [(41, None)]
    found = x.mentions(spark.createDataFrame(rows, "key long, m array<struct<kind:string,ref:string>>"), "key", F.col("m"))
    got = {tuple(r) for r in x.resolve(found, spark.createDataFrame(senses, "ref string, sense long"), spark.createDataFrame(seed, "sense long, text string, cls string")).select("key", "nth", "text", "cls", "reason").collect()}
    told = {}
    for k, text, cls in sorted((s for s in seed if s[1]), key=lambda s: (s[0], s[1], s[2] is not None, s[2] or "")):
        told.setdefault(k, (text, cls))
    want = set()
    for key, ms in rows:
        for nth, (kind, ref) in enumerate(ms or []):
            mine = sorted({s for e, s in senses if e == ref and e is not None})
            terms = {";".join(sorted(p.strip().lower() for p in told[s][0].split(";"))) for s in mine if s in told}
            classes = {told[s][1] for s in mine if s in told}
            reason = x.NOT_EQUIVALENT if kind == "see" else x.UNKNOWN if not mine else x.UNRESOLVED if any(s not in told for s in mine) else x.CONFLICTING if len(terms) > 1 or len(classes) > 1 else None
            want.add((key, nth, *((None, None) if reason else told[mine[0]]), reason))
    assert got == want and {r[4] for r in want} >= {x.NOT_EQUIVALENT, x.UNKNOWN, x.UNRESOLVED, x.CONFLICTING}


def test_phrase_rules_meet_as_in_a_walk(spark, monkeypatch):
    """Random rules and texts with every place and guard, broadcast or not, against a walk over all pairs."""
    import random

    from glossa.operators import phrase_rules as p

    rng = random.Random(3)
    make = lambda n: [rng.choice(["a", "b", "c", "d'e", "!", "f-g"]) for _ in range(n)]
    some = lambda: [" ".join(make(rng.randint(1, 2))) for _ in range(rng.choice([0, 0, 0, 1, 2]))]
    rules = [(f"r{k:04}", rng.randrange(900), " ".join(make(rng.randint(1, 6))), rng.choice(["whole", "start", "end", "any"]), some(), some(), some(), "k", "p", ["q"], []) for k in range(1500)]
    rules += [("none", 0, "...", "any", [], [], [], "k", "p", [], [])]
    texts = [(k, " ".join(make(rng.randint(0, 9))).upper()) for k in range(120)] + [(500, None), (501, "")]
    want = {}
    for k, t in texts:
        ws = (t or "").lower().split(" ") if t else []
        x, best = " " + " ".join(ws) + " ", None
        for rule, priority, phrase, place, also, without, after, *_ in rules:
            r = phrase.split(" ") if phrase != "..." else []
            for at in range(len(ws) - len(r) + 1) if r else []:
                ok = ws[at : at + len(r)] == r and (place == "any" or (place != "end") * at == 0 and (place == "start" or at + len(r) == len(ws)))
                ok = ok and (not also or any(f" {a} " in x for a in also)) and not any(f" {a} " in x for a in without)
                ok = ok and (not after or any((" " + " ".join(ws[at + len(r) :]) + " ").startswith(f" {a} ") for a in after))
                if ok and (best is None or (priority, rule, at + 1) < best):
                    best = (priority, rule, at + 1)
        if best:
            want[k] = best
    units, table = spark.createDataFrame(texts, "id long, t string"), spark.createDataFrame(rules, p.SCHEMA)
    for most in (p.BROADCAST_RULES, 10):
        monkeypatch.setattr(p, "BROADCAST_RULES", most)
        found = p.match(units, ["id"], F.col("t"), table)
        assert {r.id: (r.priority, r.rule, r.at) for r in found.collect()} == want
    small = p.match(units, ["id"], F.col("t"), table.limit(3))
    size = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("\n")
    assert abs(size(found) - size(small)) <= 2 and len(want) > 60


def test_phrase_packs(spark):
    from glossa.operators import phrase_packs, phrase_rules as p

    rows = phrase_packs.rows()
    rules = spark.createDataFrame(rows + phrase_packs.noun_rows({"pump": "object", "fear": "emotion"}, len(rows)), p.SCHEMA)
    cases = [
        ("(coll.) Watch out!", "expression", "warn"), ("a still, from a movie", "reviewed", "film still"), ("a still night", None, None), ("Unable to sleep", "state", "sleepless"),
        ("to make a mountain out of a molehill over it", "turn", "exaggerate"), ("to lose one’s head out of fear", "idiom", "panicked"), ("to lose one's head", None, None), ("never run for his life", None, None),
        ("a person who asks for advice", "social", "ask"), ("to ask the price", None, None), ("practice of helping others", "social", "help"), ("a pump used for water", "described", "pump"), ("hand pump", "named", "pump"), ("not a pump", None, None), ("great fear", None, None), (None, None, None), ("[x]", None, None),
    ]
    got = {r.id: r for r in p.plans(spark.createDataFrame([(k, c[0]) for k, c in enumerate(cases)], "id long, m string"), ["id"], F.col("m"), rules).collect()}
    assert [(got[k].rule, got[k].predicate) if k in got else (None, None) for k in range(len(cases))] == [c[1:] for c in cases]
    assert got[12].query == "hand pump" and got[11].queries == ["pump object", "pump"] and got[0].fallback == got[0].query


def test_fuzzy_finds_every_term_one_edit_away(spark):
    import random

    from glossa.operators import search as s

    rng = random.Random(9)
    terms = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(0, 7))) for _ in range(700)} - {""})
    posts = spark.createDataFrame([(k, t) for k, t in enumerate(terms)] + [(9999, terms[0])], "ord long, key string")

    def one_edit(a, b):
        if a == b:
            return False
        if len(a) == len(b):
            differ = [i for i in range(len(a)) if a[i] != b[i]]
            return len(differ) == 1 or (len(differ) == 2 and differ[1] == differ[0] + 1 and a[differ[0]] == b[differ[1]] and a[differ[1]] == b[differ[0]])
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    asked = [(k, t) for k, t in enumerate(terms) if k % 3 == 0] + [(-1, "abca"), (-2, "zzzzz"), (-3, None)]
    got = {tuple(r) for r in s.fuzzy(s.near_rows(posts), posts, spark.createDataFrame(asked, "qid long, q string")).collect()}
    want = {(q, o) for q, t in asked if t and len(t) >= 4 for o, k in [*enumerate(terms), (9999, terms[0])] if one_edit(t, k)}
    assert got == want and len(want) > 500


def test_categories_of_a_deep_graph_with_cycles(spark):
    import random

    rng = random.Random(10)
    edges = [(k, rng.randrange(max(0, k - 4), k)) for k in range(1, 80)] + [(k, rng.randrange(80)) for k in range(2, 80, 33)] + [(None, 3), (3, None)]
    marks = [(rng.randrange(12, 80), rng.choice(["x", "y", "z", "bad", "unused"])) for _ in range(14)] + [(None, "x"), (5, None)]
    rules, veto = [("x", 2, "X"), ("y", 1, "Y"), ("z", 3, "Z")], {"bad"}
    up = {}
    for c, p in edges:
        if c is not None and p is not None:
            up.setdefault(c, set()).add(p)
    want = {}
    for n in range(85):
        seen, todo = {n}, [n]
        while todo:
            for p in up.get(todo.pop(), ()):
                if p not in seen:
                    seen.add(p)
                    todo.append(p)
        mine = {m for k, m in marks if k in seen and m}
        hit = [(pr, c) for m, pr, c in rules if m in mine]
        if not mine & veto and (hit or n % 2):
            want[n] = min(hit)[1] if hit else "own"
    got = graph.categories(
        spark.createDataFrame([(n, "own" if n % 2 else None) for n in range(85)], "node long, own string"), spark.createDataFrame(edges, "child long, parent long"), spark.createDataFrame(marks, "node long, mark string"),
        spark.createDataFrame(rules, "mark string, priority int, category string"), spark.createDataFrame([("bad",)], "mark string"), "own")
    assert {r.node: r.category for r in got.collect()} == want and len(set(want.values())) > 2


def _leaf_files(df):
    """Files that a plan without exchanges has read."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().collectLeaves().head().metrics().get("numFiles").get().value()


@pytest.mark.parametrize("few, many", [(4096, True), (8, True), (8, False)])
def test_select_rank_of_hot_groups(spark, monkeypatch, few, many):
    monkeypatch.setattr(selection, "BROADCAST_GROUPS", 100_000 if many else 0)
    monkeypatch.setattr(selection, "CELLS", 16)
    rng = random.Random(9)
    rows = [("hot", rng.choice([1e300, -1e300, 1e-300, rng.gauss(0, 1), rng.expovariate(1) ** 9])) for _ in range(900)]
    rows += [("ties", 1.0)] * 300 + [("ties", 2.0)] * 300 + [("one", 5.0), (None, 4.0), (None, 2.0), ("null", None), ("hot", None)]
    rows += [("nan", float("nan"))] * 3 + [("nan", 1.0), ("nan", 2.0)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(7)
    for rank in (lambda n: F.floor(n / 2) + 1, lambda n: F.floor(n / 4)) if many else (lambda n: n,):
        got = {r.k: (r.n, r.v) for r in selection.select_rank(df, "k", "v", rank, few).collect()}
        groups = {}
        for k, v in rows:
            groups.setdefault(k, []).extend([] if v is None else [v])
        for k, vs in groups.items():
            vs.sort(key=lambda v: (v != v, v))
            n = len(vs)
            r = spark.range(1).select(rank(F.lit(n)).alias("r")).first().r
            want = vs[int(r) - 1] if 1 <= r <= n else None
            assert got[k][0] == n
            assert got[k][1] == want or (want != want and got[k][1] != got[k][1]), (k, r)
        assert len(got) == len(groups)


def test_select_rank_of_integers_and_nothing(spark):
    df = spark.range(10_000).select((F.col("id") % 3).alias("k"), (F.col("id") * 7919 % 10_007).alias("v"))
    got = {r.k: r.v for r in selection.select_rank(df, "k", "v", lambda n: F.floor(n / 2) + 1, 16).collect()}
    for k in range(3):
        vs = sorted(i * 7919 % 10_007 for i in range(k, 10_000, 3))
        assert got[k] == vs[len(vs) // 2]
    assert selection.select_rank(df.where("false"), "k", "v", lambda n: n).collect() == []


def test_versions_read_only_what_differs(spark, tmp_path):
    base = spark.range(5000).select("id", (F.col("id") % 7).alias("a"), F.when(F.col("id") % 3 > 0, F.concat(F.lit("x"), "id")).alias("b"))
    more = base.where("id <> 17").withColumn("a", F.when(F.col("id") == 99, 50).otherwise(F.col("a"))).union(spark.sql("select 9001L, 1L, 'new'"))
    old, new, same = (str(tmp_path / x) for x in ("old", "new", "same"))
    first = versions.write(base, old, ["id"], 16)
    assert versions.write(base.select("b", "id", "a").repartition(5), same, ["id"], 16) == first != versions.write(more, new, ["id"], 16)
    assert versions.diff(spark, old, same, ["id"], 16).collect() == []
    got = {r.id: r.change for r in versions.diff(spark, old, new, ["id"], 16).collect()}
    assert got == {17: "removed", 99: "changed", 9001: "added"}
    touched = versions.unequal(spark, old, new, 16)
    assert len(touched) <= 3 and versions.buckets_for(10**7) == 256
    assert _leaf_files(versions.part(spark, old, touched)) <= 3 < _leaf_files(spark.read.parquet(f"{old}/rows").where("id >= 0"))


def test_versions_of_odd_tables(spark, tmp_path):
    empty = spark.createDataFrame([], "id long, v string")
    odd = spark.createDataFrame([(None, "a"), (1, None), (1, "b"), (1, "b")], "id long, v string")
    roots = [str(tmp_path / x) for x in "abc"]
    assert versions.write(empty, roots[0], ["id"], 16) == ""
    versions.write(odd, roots[1], ["id"], 16)
    versions.write(odd.where("v = 'a' or v is null"), roots[2], ["id"], 16)
    assert {(r.id, r.change) for r in versions.diff(spark, roots[0], roots[2], ["id"], 16).collect()} == {(1, "added"), (None, "added")}
    assert versions.unequal(spark, roots[1], roots[2], 16)
    with pytest.raises(ValueError):
        versions.write(odd, str(tmp_path / "d"), ["id"], 20)


def test_ordered_lines_over_batches_and_restarts(spark, tmp_path):
    say = lambda result, done: '{"result":"%s","done":%s}' % (result, "true" if done else "false")
    told = {1: [say("a", False), say("b", False), say("c", True)], 2: [say("a", True), say("b", False)], 3: [say("a", False), "{", say("c", True)],
            4: [say("x" * 99, False)], 5: [say("a", False), say("b", False)], 6: [say("z", True)]}
    rows = [(k, i + 1, line) for k, ls in told.items() for i, line in enumerate(ls)]
    rng = random.Random(3)
    rng.shuffle(rows)
    pieces = [rows[:4], rows[4:8] + rows[:2], rows[8:] + rows[5:6], [(7, 1, say("q", True))]]  # early, late and repeated lines
    source, folder = str(tmp_path / "in"), str(tmp_path / "run")

    def put(i, second):
        df = spark.createDataFrame(pieces[i], "k long, place long, line string").withColumn("ts", F.timestamp_seconds(F.lit(second)))
        df.coalesce(1).write.mode("append").parquet(source)

    def run():
        lines = spark.readStream.schema("k long, place long, line string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(source)
        return streams.with_rocksdb(spark, lambda: streams.run_available(streams.ordered_lines(lines, "k", 80), folder=folder))

    put(0, 1000), put(1, 1001)
    run()
    put(2, 1002)
    out = run()  # goes on from the checkpoint
    last = lambda df: {r.k: (r.error, r.result) for r in df.groupBy("k").agg(F.max_by("error", "place").alias("error"), F.max_by("result", "place").alias("result")).collect()}
    ends = {1: (None, "c"), 2: ("after-final", None), 3: ("malformed", None), 4: ("oversized", None), 6: (None, "z")}
    assert last(out) == ends
    put(3, 9000)  # time passes: a stream without its final line is given up
    assert last(run()) == ends | {5: ("no-final", None), 7: (None, "q")}


@pytest.mark.parametrize("part", [1, 7, 64, 1 << 20])
def test_json_arrays_by_byte_ranges(tmp_path, part):
    rng = random.Random(part)
    pieces = ["a", '"', "\\", "[", "]", "{", "}", ",", "é", " ", "\n", "\\\\\\"]
    values = [{"i": i, "s": "".join(rng.choices(pieces, k=rng.randrange(12))), "n": [[i], {"x": "]"}]} for i in range(30)] + ["", 3, None, [], {}]
    raw = ("\ufeff \n[" + " ,\n".join(json.dumps(v, ensure_ascii=i % 2 == 0) for i, v in enumerate(values)) + " ]\n").encode()
    path = tmp_path / "a.json"
    path.write_bytes(raw)
    cuts = list(range(0, len(raw), part))
    found = [r for pdf in ranges._summaries(iter([pd.DataFrame({"path": [str(path)] * len(cuts), "size": len(raw), "begin": cuts, "end": [min(len(raw), a + part) for a in cuts]})])) for r in pdf.itertuples(index=False)]
    got, inside, depth, begun = [], False, 0, False
    with ranges.open_file(str(path)) as f:
        for r in found:
            got += list(ranges._elements(f, r.size, r.begin, r.end, inside, depth, begun, 10_000))
            inside, depth, begun = (r.s1, depth + r.d1, begun) if inside else (r.s0, depth + r.d0, begun or not r.blank)
    assert [json.loads(x) for x in got] == values and not inside and depth == 0


def test_json_array_read_by_several_tasks(spark, tmp_path):
    rows = [{"id": i, "name": "[]{},\\\"" * (i % 9), "more": "x" * (500 if i % 10 == 0 else 1)} for i in range(400)]
    (tmp_path / "a.json").write_text(json.dumps(rows, indent=1))
    (tmp_path / "b.json").write_text("[]")
    read = readers.read_json_array(spark, str(tmp_path / "*.json"), "id int, name string, more string", most=400, part=1000)
    got = read.collect()
    assert sorted((r.row.id, r.row.name) for r in got if r.error is None) == [(r["id"], r["name"]) for r in rows if r["id"] % 10]
    assert sum(r.error == "oversized-record" for r in got) == 40
    for bad in ("[1, 2", "{}", "[1] 2", '["a]'):
        (tmp_path / "c.txt").write_text(bad)
        with pytest.raises(Exception, match="JSON array"):
            readers.read_json_array(spark, str(tmp_path / "c.txt"), "id int", part=3).collect()


@pytest.mark.parametrize("part", [1, 5, 64, 1 << 20])
def test_tar_lines_by_byte_ranges(tmp_path, part):
    bodies = {"d/data.noun": "one\n\ntwé\r\nthree" + "x" * 30 + "\n", "d/empty": "", "d/data.verb": "no break at its end", "e": "\n\n"}
    path = str(tmp_path / "a.tar")
    with tarfile.open(path, "w") as t:
        for name, body in bodies.items():
            info = tarfile.TarInfo(name)
            info.size = len(body.encode())
            t.addfile(info, io.BytesIO(body.encode()))
    reader = ranges._TarReader([path], part)
    got = {}
    for piece in reader.partitions():
        for _, member, _, line in reader.read(piece):
            got.setdefault(member, []).append(line)
    assert got == {name: [x.rstrip("\r") for x in body.removesuffix("\n").split("\n")] for name, body in bodies.items() if body}


def test_tar_members_that_are_not_asked_for_are_not_read(spark, tmp_path):
    path = str(tmp_path / "a.tar")
    with tarfile.open(path, "w") as t:
        for name, body in (("w/data.noun", "  head\n00000001 03 n | a thing | of sorts\n"), ("w/data.adj", "00000002 03 a | nice "), ("w/index", "00000003 | no\n")):
            info = tarfile.TarInfo(name)
            info.size = len(body)
            t.addfile(info, io.BytesIO(body.encode()))
    lines = ranges.read_tar_lines(spark, path, 16)
    got = {tuple(r) for r in readers.tar_glosses(lines).collect()}
    assert got == {("00000001-n", "a thing | of sorts"), ("00000002-a", "nice")}
    assert lines.where("member = 'w/index'").select("line").collect()[0].line == "00000003 | no"
    some = ranges.read_tar_lines(spark, path, 16, "/data[.]")
    assert lines.count() == 4 and some.count() == 3
    assert 1 < some.rdd.getNumPartitions() < lines.rdd.getNumPartitions()
