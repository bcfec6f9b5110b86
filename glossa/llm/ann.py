"""Operator 2: approximate nearest neighbours by learned partitions.

On a bounded sample: the neighbour graph is split into balanced parts (recursive bisection,
refined by exchanging pairs across the cut), and a small network learns in which parts the
neighbours of a vector lie. The network assigns every row to its most probable part (the
index) and sends a query to several most probable parts, where all rows are reranked by the
exact distance in double precision. The number of parts probed is the least that gives the
wanted recall on sample vectors that the network was not fitted on.

A part is searched in chunks of bounded size, each against bounded blocks of queries. Of equal
vectors only the k + 1 smallest ids of an Arrow batch can be among anyone's k nearest, so a
vector that a third of all rows share shrinks before it is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glossa.session import cut

#: Vectors the index is fitted on, at most. Parts grow with the square root of the rows, a quarter of it as a power of
#: two, up to what the sample can tell apart (an eighth of it). A table of fewer than FEW_ROWS is one part: all of it is searched.
SAMPLE, FEW_ROWS = 8192, 1000
#: Rows in a chunk of a part, and queries that one task compares with it.
CHUNK_ROWS, QUERY_BLOCK = 4000, 4096
#: Recall wanted on the held-out part of the sample when the number of probes is chosen.
WANTED = 0.97


def neighbours(x: np.ndarray, k: int, y: np.ndarray | None = None) -> np.ndarray:
    """The k nearest rows of x for each row of y (of x itself: others only)."""
    q = x if y is None else y
    out = np.empty((len(q), k), np.int64)
    sq = (x * x).sum(1)
    for a in range(0, len(q), 512):
        d = sq[None] - 2 * q[a : a + 512] @ x.T
        if y is None:
            d[np.arange(len(d)), np.arange(a, a + len(d))] = np.inf
        out[a : a + 512] = np.argpartition(d, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int) -> np.ndarray:
    """A part of each vector, all of one size within one, with few graph edges between parts. parts is a power of two."""
    label = np.zeros(len(x), np.int64)
    level = 1
    while level < parts:
        new = np.empty_like(label)
        for p in range(level):
            mine = np.flatnonzero(label == p)
            side = _bisect(x, graph, mine)
            new[mine] = 2 * p + side
        label, level = new, level * 2
    return label


def _bisect(x: np.ndarray, graph: np.ndarray, mine: np.ndarray) -> np.ndarray:
    n = len(mine)
    if n < 2:
        return np.zeros(n, np.int64)
    z = x[mine] - x[mine].mean(0)
    v = np.ones(z.shape[1]) + np.arange(z.shape[1]) * 1e-3
    for _ in range(20):  # the direction of most variance
        v = z.T @ (z @ v)
        v /= np.linalg.norm(v) + 1e-30
    side = np.zeros(n, np.int64)
    side[np.argsort(z @ v, kind="stable")[n // 2 :]] = 1
    local = np.full(len(x), -1)
    local[mine] = np.arange(n)
    to = local[graph[mine]]
    u, w = np.repeat(np.arange(n), to.shape[1])[to.ravel() >= 0], to.ravel()[to.ravel() >= 0]
    for _ in range(12):
        other = np.bincount(u, side[w] != side[u], n) + np.bincount(w, side[w] != side[u], n)
        gain = 2 * other - np.bincount(u, minlength=n) - np.bincount(w, minlength=n)
        a, b = (np.flatnonzero(side == s) for s in (0, 1))
        a, b = a[np.argsort(-gain[a], kind="stable")], b[np.argsort(-gain[b], kind="stable")]
        m = min(len(a), len(b))
        good = int(np.count_nonzero(gain[a[:m]] + gain[b[:m]] > 2)) // 2  # half of them, as neighbours may both move
        if not good:
            break
        side[a[:good]], side[b[:good]] = 1, 0
    return side


@dataclass(frozen=True)
class Router:
    """A network of one hidden layer: the probability that neighbours of a vector lie in each part."""

    mean: np.ndarray
    scale: float
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    probes: int
    recall: float

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        h = np.maximum(((x - self.mean) / self.scale) @ self.w1 + self.b1, 0)
        s = h @ self.w2 + self.b2
        e = np.exp(s - s.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    @property
    def parts(self) -> int:
        return len(self.b2)


def fit(sample: np.ndarray, parts: int, k: int = 10, hidden: int = 128, epochs: int = 40) -> Router:
    """Partition the sample's neighbour graph, learn the router, and choose the number of probes."""
    rng = np.random.default_rng(5)
    d = sample.shape[1] if sample.ndim == 2 else 1
    mean = sample.mean(0) if len(sample) else np.zeros(d)
    scale = float(sample.std()) or 1.0 if len(sample) else 1.0
    if parts < 2 or len(sample) < 8 * parts:
        return Router(mean, scale, np.zeros((d, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1), 1, 1.0)
    x = (sample - mean) / scale
    test = np.zeros(len(x), bool)
    test[rng.permutation(len(x))[: min(512, len(x) // 8)]] = True
    base, asked = x[~test], x[test]
    graph = neighbours(base, k)
    label = balanced_parts(base, graph, parts)
    target = np.zeros((len(base), parts))
    np.add.at(target, (np.repeat(np.arange(len(base)), k), label[graph].ravel()), 0.5 / k)
    target[np.arange(len(base)), label] += 0.5
    p = [rng.standard_normal((d, hidden)) * np.sqrt(2 / d), np.zeros(hidden), rng.standard_normal((hidden, parts)) * np.sqrt(1 / hidden), np.zeros(parts)]
    m1, m2, step = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p], 0
    for _ in range(epochs):
        order = rng.permutation(len(base))
        for a in range(0, len(base), 256):
            i = order[a : a + 256]
            h = np.maximum(base[i] @ p[0] + p[1], 0)
            s = h @ p[2] + p[3]
            e = np.exp(s - s.max(1, keepdims=True))
            g = (e / e.sum(1, keepdims=True) - target[i]) / len(i)
            gh = (g @ p[2].T) * (h > 0)
            step += 1
            for j, grad in enumerate((base[i].T @ gh, gh.sum(0), h.T @ g, g.sum(0))):
                m1[j] = 0.9 * m1[j] + 0.1 * grad
                m2[j] = 0.999 * m2[j] + 0.001 * grad * grad
                p[j] -= 3e-3 * (m1[j] / (1 - 0.9**step)) / (np.sqrt(m2[j] / (1 - 0.999**step)) + 1e-8)
    router = Router(mean, scale, *p, probes=1, recall=0.0)
    home = router.probabilities(sample[~test]).argmax(1)
    rank = np.argsort(np.argsort(-router.probabilities(sample[test]), axis=1, kind="stable"), axis=1, kind="stable")
    where = rank[np.arange(len(asked))[:, None], home[neighbours(base, k, asked)]]
    for probes in range(1, parts + 1):
        recall = float((where < probes).mean())
        if recall >= WANTED:
            break
    return Router(mean, scale, *p, probes=probes, recall=recall)


def valid_vectors(df: DataFrame, id_col: str, vector: str) -> DataFrame:
    """(vec_id, v): ids with vectors that take part, of the most common dimension."""
    rows = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector).alias("v")).where(_takes_part(F.col("v")))
    dims = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    return rows.where(F.size("v") == (dims[0][0] if dims else 0))


def _takes_part(v):
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _index(router: Router, k: int):
    """Rows with their part and vector bytes; of a batch's equal vectors, the k + 1 smallest ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x, ids = _matrix(b.column("v")), b.column("vec_id").to_numpy()
            raw = np.ascontiguousarray(x).view(np.dtype((np.void, x.shape[1] * 8))).ravel()
            _, group = np.unique(raw, return_inverse=True)
            by = np.lexsort((ids, group))
            first = np.flatnonzero(np.diff(group[by], prepend=-1))
            nth = np.arange(len(by)) - np.repeat(first, np.diff(first, append=len(by)))
            use = np.sort(by[nth <= k])
            part = router.probabilities(x[use]).argmax(1)
            yield pa.RecordBatch.from_arrays([pa.array(ids[use]), pa.array(part, pa.int32()), pa.array([r.tobytes() for r in x[use]], pa.binary())], ["vec_id", "part", "v"])

    return run


def _route(router: Router, count: np.ndarray, k: int):
    """Queries with the parts they go to: the most probable ones, more while these hold too few rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x, ids = _matrix(b.column("v")), b.column("vec_id").to_numpy()
            order = np.argsort(-router.probabilities(x), axis=1, kind="stable")
            held = np.cumsum(count[order], axis=1)
            enough = (np.arange(1, len(count) + 1)[None] >= router.probes) & (held > 4 * (k + 1))
            n = np.where(enough.any(1), enough.argmax(1) + 1, len(count))
            row = np.repeat(np.arange(len(ids)), n)
            place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(order[row, place], pa.int32()), pa.array([x[i].tobytes() for i in row], pa.binary())], ["query_id", "part", "q"])

    return run


def nearest(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, candidate row, distance): the k nearest distinct ids of each query but its own, nearest first."""
    out = ([], [], [])
    by = np.argsort(ids, kind="stable")
    x, ids = x[by], ids[by]
    sq = (x * x).sum(1)
    top = float(sq.max()) if len(sq) else 0.0
    for a in range(0, len(q), 128):
        qq = q[a : a + 128]
        qs = (qq * qq).sum(1)
        d = sq[None] - 2 * qq @ x.T + qs[:, None]
        d[q_ids[a : a + 128, None] == ids[None]] = np.inf
        kth = np.partition(d, min(k, d.shape[1]) - 1, axis=1)[:, min(k, d.shape[1]) - 1]
        slack = 1e-11 * (top + qs + 1)  # beyond the rounding of the product form
        for i in range(len(qq)):
            limit = kth[i] + slack[i]
            c = np.flatnonzero(d[i] <= limit) if np.isfinite(limit) else np.flatnonzero(np.isfinite(d[i]))
            while True:
                exact = np.sqrt(((x[c] - qq[i]) ** 2).sum(1))
                best = c[np.lexsort((ids[c], exact))]
                dist = np.sort(exact)
                distinct = np.sort(np.unique(ids[best], return_index=True)[1])
                if len(distinct) >= k or len(c) >= np.isfinite(d[i]).sum():
                    break
                c = np.flatnonzero(np.isfinite(d[i]))  # repeated ids took places
            distinct = distinct[:k]
            out[0].append(np.full(len(distinct), a + i))
            out[1].append(by[best[distinct]])
            out[2].append(dist[distinct])
    return tuple(np.concatenate(o) if o else np.zeros(0, np.int64) for o in out)


def _search(k: int):
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})
        x = np.frombuffer(b"".join(left["v"]), np.float64).reshape(len(left), -1)
        q = np.frombuffer(b"".join(right["q"]), np.float64).reshape(len(right), -1)
        ids, q_ids = left["vec_id"].to_numpy(), right["query_id"].to_numpy()
        i, j, d = nearest(q, q_ids, x, ids, k)
        return pd.DataFrame({"query_id": q_ids[i], "vec_id": ids[j], "score": d})

    return run


def _map(values: list[int]):
    return F.array(*[F.lit(int(v)) for v in values])


def parts_for(n: int) -> int:
    """The number of parts of a table of n vectors."""
    return 1 if n < FEW_ROWS else 1 << int(np.clip(np.round(np.log2(np.sqrt(n) / 4)), 1, np.log2(SAMPLE // 8)))


def search(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", every: int = 100, k: int = 10) -> DataFrame:
    """Each query's k nearest found: query_id, rank (from 1), vec_id, score.

    Queries: rows whose id is divisible by `every`; candidates: every row but the query's own
    id. Vectors that are null, zero, or hold null or non-finite components take no part, nor do
    null ids and vectors whose dimension is not the most common one. Rows that repeat an id
    count once, at their nearest. Fewer candidates than k: all of them, if the table is that
    small. An empty table gives no rows.
    """
    spark = df.sparkSession
    rows = valid_vectors(df, id_col, vector)
    n = rows.count()
    place = F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    got = rows.withColumn("p", place).where(F.col("p") < min(1.0, 1.2 * SAMPLE / max(n, 1))).orderBy("p", "vec_id", "v").limit(SAMPLE).select("v").collect()
    sample = np.array([r.v for r in got], np.float64)
    parts = parts_for(n)
    router = fit(sample, parts, k)
    index = cut(rows.mapInArrow(_index(router, k), "vec_id long, part int, v binary"))
    count = np.zeros(router.parts, np.int64)
    for r in index.groupBy("part").count().collect():
        count[r["part"]] = r["count"]
    asked = rows.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id"])
    routed = cut(asked.mapInArrow(_route(router, count, k), "query_id long, part int, q binary"))
    asks = np.zeros(router.parts, np.int64)
    for r in routed.groupBy("part").count().collect():
        asks[r["part"]] = r["count"]
    chunks = [max(1, -(-int(c) // CHUNK_ROWS)) for c in count]
    blocks = [max(1, -(-int(a) // QUERY_BLOCK)) for a in asks]
    in_chunk = F.pmod(F.xxhash64("vec_id"), F.element_at(_map(chunks), F.col("part") + 1)).cast("int")
    in_block = F.pmod(F.xxhash64("query_id"), F.element_at(_map(blocks), F.col("part") + 1)).cast("int")
    left = index.withColumn("chunk", in_chunk).withColumn("block", F.explode(F.sequence(F.lit(0), F.element_at(_map(blocks), F.col("part") + 1) - 1)))
    right = routed.withColumn("block", in_block).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.element_at(_map(chunks), F.col("part") + 1) - 1)))
    key = ["part", "chunk", "block"]
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(_search(k), "query_id long, vec_id long, score double")
    best = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark, sf_dir):
    """op2: rows of embeddings whose id is divisible by 100, against all rows."""
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
