"""Operators 11 to 13 against brute force, and their odd rows."""

from __future__ import annotations

import collections
import hashlib
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from glossa.llm import exact_topk, merkle, vector_codes

D = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<float>, label int"


def vectors(seed, n, d, spread=1.0, ids=None):
    """Clustered vectors with copies, one of them held by a third of the rows."""
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((12, d)) * spread
    x = (centres[rng.integers(0, 12, n)] + 0.3 * rng.standard_normal((n, d))).astype(np.float32)
    x[::3] = x[0]
    return [(int(i) if ids is None else ids[i], x[i].tolist(), None if i % 7 == 0 else i % 3) for i in range(n)]


BAD = [(900, None, 1), (901, [float("nan")] * 8, 1), (902, [None] * 8, 2), (903, [float("inf")] * 8, 2), (904, [1.0], None), (905, [], 1), (906, [3e38] * 8, 1)]


def odd(rows, d):
    return rows + [(i, v if v is None or len(v) < 8 else (v * d)[:d], label) for i, v, label in BAD]


# 11
def lloyd(rows, parts=8, entries=16, rounds=6):
    """(codes, errors, codebooks) by full scans over Python integers; rows in order of their ids."""
    x = [[int(np.floor(4096 * float(np.float32(c)))) for c in v] for _, v, _ in rows]
    w = len(x[0]) // parts
    cut = [[v[p * w : (p + 1) * w] for p in range(parts)] for v in x]
    books = [[cut[r][p] for r in range(min(entries, len(cut)))] for p in range(parts)]
    far = lambda a, b: sum((i - j) ** 2 for i, j in zip(a, b))
    near = lambda v, book: min(range(len(book)), key=lambda e: (far(v, book[e]), e))
    for _ in range(rounds):
        for p in range(parts):
            by = collections.defaultdict(list)
            for v in cut:
                by[near(v[p], books[p])].append(v[p])
            for e, vs in by.items():
                books[p][e] = [sum(c) // len(vs) for c in zip(*vs)]
    codes = [[near(v[p], books[p]) for p in range(parts)] for v in cut]
    errors = [sum(far(v[p], books[p][c]) for p, c in enumerate(code)) for v, code in zip(cut, codes)]
    return codes, errors, books


@pytest.mark.parametrize(("n", "d", "block"), [(150, 16, 4096), (200, 8, 7), (5, 16, 2), (1, 8, 4)])
def test_codes_equal_full_scans(spark, n, d, block):
    rows = vectors(n, n, d)
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(odd(rows, d), VECTORS).withColumns({c: F.lit(1) for c in ("v", "kept", "code", "error", "x")}).repartition(3)
    scans: list[int] = []
    out, books = vector_codes.compress(df, keep=("label", "code"), block_rows=block, report=scans)
    rows.sort()
    codes, errors, want = lloyd(rows)
    assert books.entries.tolist() == want
    assert books.digest() == hashlib.sha256(",".join(str(c) for p in want for e in p for c in e).encode()).hexdigest()
    got = {r.vec_id: (r.code, r.error, r.kept.label) for r in out.collect()}
    assert got == {i: ("".join(f"{c:02x}" for c in code), e, label) for (i, _, label), code, e in zip(rows, codes, errors)}
    assert scans[0] == 8 * n and (n < 100 or scans[-1] < 0.8 * scans[0])
    by = collections.defaultdict(int)
    for i, (_, e, label) in got.items():
        by[label] += e
    with_sums = vector_codes.with_label_error(out, "label").collect()
    assert len(with_sums) == n and all(r.label_error == by[r.kept.label] for r in with_sums)


def test_bounds_keep_ties_at_the_lower_index():
    """Entries that meet, swap and tie: codes of every round are those of full scans."""
    rng = np.random.default_rng(4)
    for _ in range(60):
        k = int(rng.integers(1, 9))
        x = rng.integers(-3, 4, (120, 2, 3))
        old = rng.integers(-3, 4, (2, k, 3))
        b = vector_codes.assign(x, old)
        for _ in range(4):
            new = old + rng.integers(-1, 2, old.shape)
            vector_codes.reassign(x, b, old, new)
            d = ((x[:, :, None] - new[None]) ** 2).sum(3)
            assert (b.code == d.argmin(2)).all()
            assert (b.upper.astype(float) ** 2 >= d.min(2)).all()
            if k > 1:
                assert (b.lower.astype(float) ** 2 <= np.partition(d, 1, 2)[..., 1]).all()
            old = new


def test_codes_of_rare_labels_and_odd_tables(spark):
    rows = [(i % 40 if i % 5 else None, [float(i % 9), 1.0] * 4, i if i % 2 else -1) for i in range(3000)]
    out, _ = vector_codes.compress(spark.createDataFrame(rows, VECTORS), keep=("label",))
    got = vector_codes.with_label_error(out, "label").collect()
    by = collections.defaultdict(int)
    for r in got:
        by[r.kept.label] += r.error
    assert len(got) == 3000 and all(r.label_error == by[r.kept.label] for r in got)
    out, books = vector_codes.compress(spark.createDataFrame(BAD[:2], VECTORS), keep=("label",))
    assert vector_codes.with_label_error(out, "label").count() == 0 and books.entries.size == 0
    assert books.digest() == hashlib.sha256(b"").hexdigest()


def test_decode(spark):
    out, books = vector_codes.compress(spark.createDataFrame([(i, [i / 16.0] * 8, 0) for i in range(4)], VECTORS))
    assert all(np.allclose(books.decode(r.code), r.vec_id / 16, atol=1 / 4096) for r in out.collect())


# 12
def netted(*values):
    return "".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def tree(leaves):
    """(root, path of each leaf as (place, siblings)) by whole levels."""
    path, at, level = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(level) > 1:
        for k, i in enumerate(at):
            run = level[i // 3 * 3 : i // 3 * 3 + 3]
            path[k].append((i % 3, run[: i % 3] + run[i % 3 + 1 :]))
        at = [i // 3 for i in at]
        level = [sha("".join(level[i : i + 3])) for i in range(0, len(level), 3)]
    return level[0], path


def refold(leaf, path):
    for place, others in path:
        leaf = sha("".join([*others[:place], leaf, *others[place:]]))
    return leaf


@pytest.mark.parametrize("n", [1, 2, 3, 4, 8, 9, 10, 26, 27, 28, 80, 81, 100, 243])
def test_paths_with_scheduled_stacks(n):
    leaves = [sha(str(i)) for i in range(n)]
    h = merkle.height_of(n)
    watch: dict = {}
    got = [[(p, [s.decode() for s in o]) for p, o in path] for path in merkle.paths([v.encode() for v in leaves], h, watch)]
    root, want = tree(leaves)
    assert got == want and merkle.root_of([v.encode() for v in leaves], h).decode() == root
    assert watch.get("late", 0) == 0 and watch["held"] <= 9 * h + 3


def test_memory_grows_with_the_height():
    held = {}
    for h in (3, 5, 7):
        watch: dict = {}
        for _ in merkle.paths([str(i).encode() for i in range(3**h)], h, watch):
            pass
        held[h] = watch["held"]
        assert watch["late"] == 0
    assert all(n <= 8 * h for h, n in held.items())  # a run of three now, three prepared, and two open nodes at each height


def manifest_of(rows):
    """(doc_id, leaf, subroot, root, path) of rows (doc_id, source, text), by brute force."""
    by = collections.defaultdict(list)
    for i, s, t in rows:
        by[s].append((i is not None, i, sha(netted(i, s, t))))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: (sorted(by[s], key=lambda v: (v[0], v[1] or 0, v[2])),) for s in order}
    trees = {s: (v, *tree([x[2] for x in v])) for s, (v,) in trees.items()}
    root, above = tree([trees[s][1] for s in order]) if order else (None, [])
    return [(v[1], v[2], sub, root, p + above[k]) for k, s in enumerate(order) for (v, p) in zip(trees[s][0], trees[s][2]) for sub in [trees[s][1]]]


@pytest.mark.parametrize("height", [1, 2, 7])
def test_manifest(spark, height):
    rng = random.Random(height)
    rows = [(None if i % 29 == 0 else rng.randrange(60), rng.choice(["hot"] * 4 + [None, "", "é", "z", "a"] + [f"s{k}" for k in range(30)]), rng.choice(["", None, "x\ny", "é" * 9, "long " * 20000])) for i in range(260)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumns({c: F.lit(c) for c in ("g", "leaf", "path", "ord", "total", "root", "digest", "at")})
    found = merkle.manifest(df.repartition(5), "doc_id", "source", merkle.leaf_digest(F.col("doc_id"), F.col("source"), F.col("text")), {"leaf": F.col("leaf")}, height)
    got = found.withColumn("back", merkle.fold(F.col("leaf"), F.col("path"))).collect()
    flat = lambda p: tuple((place, tuple(o)) for place, o in p)
    mine = collections.Counter((r.id, r.leaf, r.subroot, r.root, flat((s.place, s.siblings) for s in r.path)) for r in got)
    assert mine == collections.Counter((i, leaf, sub, root, flat(p)) for i, leaf, sub, root, p in manifest_of(rows))
    assert all(r.back == r.root and r.carried.leaf == "leaf" for r in got)


def test_manifest_query(spark, tmp_path):
    rows = [(i if i else None, None if i % 4 == 0 else f"s{i % 3}", "en" if i % 2 else None, i, None if i == 5 else "line\n" * (i % 3)) for i in range(50)]
    spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in merkle.query(spark, str(tmp_path)).collect()}
    for i, s, lang, n, t in rows:
        odd_leaf = i is not None and zlib.crc32(str(i).encode()) % 2 == 0 and "\n" in (t or "")
        assert got[i].leaf == sha(netted(i, s, lang, n, t)) and got[i].verified == (not odd_leaf) == (got[i].folded_root == got[i].root)
    assert len({r.root for r in got.values()}) == 1
    empty = spark.createDataFrame([], "doc_id long, source string")
    assert merkle.manifest(empty, "doc_id", "source", merkle.leaf_digest(F.col("doc_id"))).count() == 0


# 13
def best(rows, every=100, k=10):
    d = collections.Counter(len(v) for _, v, _ in rows).most_common(1)[0][0]
    x = [(i, [int(np.floor(1024 * float(np.float32(c)))) for c in v]) for i, v, _ in rows if i is not None and len(v) == d]
    out = set()
    for i in {i for i, _ in x if i % every == 0}:
        score: dict = {}
        for _, q in [v for v in x if v[0] == i]:
            for j, v in x:
                if j != i:
                    s = sum(a * b for a, b in zip(q, v))
                    score[j] = max(score.get(j, s), s)
        out |= {(i, r + 1, j, s) for r, (j, s) in enumerate(sorted(score.items(), key=lambda v: (-v[1], v[0]))[:k])}
    return out


@pytest.mark.parametrize(("n", "d", "spread", "pivots"), [(600, 8, 3.0, 32), (400, 16, 0.1, 4), (300, 8, 0.0, 1), (7, 8, 1.0, 8)])
def test_topk_equals_all_products(spark, n, d, spread, pivots):
    ids = [None if i % 50 == 7 else i // 2 if i % 10 == 0 else i for i in range(n)]  # null and repeated ids
    rows = vectors(n, n, d, spread, ids) + [(5000, [0.0] * d, 1), (5100, [0.0] * d, 1)]
    df = spark.createDataFrame(odd(rows, d), VECTORS).withColumns({c: F.lit(1) for c in ("home", "away", "x", "d", "score", "rank")})
    got = exact_topk.search(df.repartition(3), every=20, pivots=pivots, chunk_rows=37, query_block=11).collect()
    assert {tuple(r) for r in got} == best(rows, 20) and len(got) == len({tuple(r) for r in got})


def test_topk_leaves_chunks_and_candidates_out(spark):
    """On clustered vectors bounds leave out most candidates, and what is left out changes nothing."""
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((20, 16)) * 3000
    x = np.concatenate([(c + 60 * rng.standard_normal((200, 16))) for c in centres]).astype(np.int64)
    ids = np.arange(len(x))
    pivots = exact_topk.choose_pivots(x[::7], 32)
    d = exact_topk.pivot_distances(x, pivots)
    some = ids[::50]
    floors = exact_topk._floors(x[:200], ids[:200], np.arange(0, 200, 50), 10)
    asked = {"ids": some[:4], "x": x[some[:4]], "d": d[some[:4]], "floor": floors}
    done = 0
    merged = collections.defaultdict(list)
    for a in range(0, len(x), 200):
        found, n = exact_topk.evaluate({"ids": ids[a : a + 200], "x": x[a : a + 200], "d": d[a : a + 200]}, asked, 10)
        done += n
        for i, s, j in found:
            merged[i] += list(zip((-s).tolist(), j.tolist()))
    for i in range(4):
        s = x @ asked["x"][i]
        want = sorted((-int(v), int(j)) for j, v in enumerate(s) if j != asked["ids"][i])[:10]
        assert sorted(merged[i])[:10] == want
    assert done < 0.4 * 4 * len(x)


def test_topk_of_empty_tables(spark):
    df = spark.createDataFrame(BAD, VECTORS)
    assert exact_topk.search(df.limit(0)).count() == 0 and exact_topk.search(df.where("vec_id < 904")).count() == 0


@pytest.mark.parametrize("module", [vector_codes, merkle, exact_topk])
def test_queries_equal_sql(spark, module):
    db = duckdb.connect()
    for t in ("documents", "embeddings"):
        db.execute(f"create view {t} as select * from '{D}/{t}.parquet'")
    got = module.query(spark, D)
    want = db.sql(module.ORACLE)
    assert got.columns == want.columns and sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def test_workers_drop_what_other_operators_left():
    from glossa.llm import common

    held = {"codec": [1], "other": [2]}
    for name in held:
        common.resident(name, held[name].clear)
    common.alone("codec")
    assert held == {"codec": [1], "other": []}
    common.alone()
    assert held["codec"] == [] and not common._resident
