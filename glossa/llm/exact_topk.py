"""Operator 13: exact top-k by inner product, with a table of distances to pivots.

Vectors become whole numbers. A bounded sample gives pivots, chosen far from each other, the
first one being the origin; every row keeps its distances to all of them (the pivot table). As
|d(q, p) - d(c, p)| <= d(q, c) for every pivot p, the largest of these is a lower bound of the
distance, and (|q|^2 + |c|^2 - bound^2) / 2 an upper bound of the inner product.

Rows are range-partitioned by their nearest pivot and the distance to it, and packed into
chunks of bounded size with the span of each pivot's distances. A query first meets the chunk
that holds it, whose k-th best score it takes along as its floor. Blocks of queries then meet all
chunks, each pair in a group of its own: a chunk whose spans bound all scores below a query's
floor is left; in others candidates are evaluated in the order of their bounds until the next
bound is below the k-th best score so far. Bounds carry a slack above the rounding of single
floats, so nothing is lost, and the pivots decide only how much is evaluated.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glossa.llm.common import pack, trim, unpack
from glossa.llm.vectors import narrow, whole, whole_vectors
from glossa.session import cut

SCALE = 1024
#: Pivots, the sample they are chosen from, rows of a chunk, and queries of a block.
PIVOTS, SAMPLE, CHUNK_ROWS, QUERY_BLOCK = 32, 4096, 4096, 2048
#: Candidates that a query evaluates first in a chunk; twice as many at each further step.
FIRST = 64
#: Slack of a distance of single floats, and of a bound made of it, as shares of the largest distance and of the squared norms.
SLACK, WIDEN = 4e-7, 1e-9


def choose_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """The origin, then rows of the sample, each farthest from those before it; fewer if the sample has fewer different ones."""
    out = [np.zeros(sample.shape[1], np.int64)]
    gap = (sample**2).sum(1)
    while len(out) < count and len(gap) and gap.max() > 0:
        out.append(sample[int(gap.argmax())])
        gap = np.minimum(gap, ((sample - out[-1]) ** 2).sum(1))
    return np.array(out, np.int64)


def pivot_distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.stack([np.sqrt(((x - p) ** 2).sum(1).astype(np.float64)) for p in pivots], 1).astype(np.float32)


def top(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of different ids, ties to the smaller id; an id counts at its best score."""
    if len(scores) > 4 * k and len(np.unique(ids)) == len(ids):
        keep = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
        scores, ids = scores[keep], ids[keep]
    by = np.lexsort((ids, -scores))
    first = np.sort(np.unique(ids[by], return_index=True)[1])[:k]
    return scores[by][first], ids[by][first]


def products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of x with q; through doubles where every sum stays below 2**53."""
    if len(x) and float(np.abs(x).max()) * float(np.abs(q).max()) * x.shape[1] < 2.0**53:
        return (x.astype(np.float64) @ q.astype(np.float64)).astype(np.int64)
    return x @ q


def evaluate(chunk: dict, asked: dict, k: int) -> tuple[list[tuple[int, np.ndarray, np.ndarray]], int]:
    """((query row, scores, ids) that may be among each query's k best, and how many candidates were evaluated).

    chunk: ids, x, d (distances to pivots); asked: ids, x, d, floor.
    """
    x, d, ids = chunk["x"], chunk["d"], chunk["ids"]
    norm = (x**2).sum(1).astype(np.float64)
    low, high, most = d.min(0), d.max(0), norm.max()
    q_norm = (asked["x"] ** 2).sum(1).astype(np.float64)
    slack = SLACK * max(float(high.max()), float(asked["d"].max()))
    off = np.maximum(np.maximum(asked["d"] - high, low - asked["d"]).max(1) - slack, 0).astype(np.float64)
    reach = (q_norm + most - off**2) / 2 + WIDEN * (q_norm + most)
    real = x.astype(np.float64) if float(np.abs(x).max()) * float(np.abs(asked["x"]).max()) * x.shape[1] < 2.0**53 else None
    columns = np.ascontiguousarray(d.T)
    out, evaluated = [], 0
    for i in np.flatnonzero(reach >= asked["floor"]):
        q, floor = asked["x"][i], asked["floor"][i]
        gap = np.zeros(len(x), np.float32)
        for p, at in enumerate(asked["d"][i]):
            np.maximum(gap, np.abs(columns[p] - at), out=gap)
        gap = np.maximum(gap - slack, 0).astype(np.float64)
        both = q_norm[i] + norm
        bound = (both - gap * gap) / 2 + WIDEN * both
        left = np.flatnonzero((bound >= floor) & (ids != asked["ids"][i]))
        order = left[np.argsort(-bound[left], kind="stable")]
        scores, found, at, step = np.zeros(0, np.int64), np.zeros(0, np.int64), 0, FIRST
        while at < len(order) and bound[order[at]] >= floor:
            rows = order[at : at + step]
            got = (real[rows] @ q.astype(np.float64)).astype(np.int64) if real is not None else x[rows] @ q
            scores, found = top(np.concatenate([scores, got]), np.concatenate([found, ids[rows]]), k)
            if len(scores) == k:
                floor = max(floor, float(scores[-1]))
            at, step = at + len(rows), 2 * step
        evaluated += min(at, len(order))
        keep = scores >= asked["floor"][i]
        if keep.any():
            out.append((int(i), scores[keep], found[keep]))
    return out, evaluated


def _measure(pivots: np.ndarray, scale: int, every: int, k: int):
    """Rows with their distances; of a batch's equal vectors only the k + 1 smallest ids, and all queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x, ids = whole(b.column("v"), scale), b.column("vec_id").to_numpy()
            raw = np.ascontiguousarray(x).view(np.dtype((np.void, x.shape[1] * 8))).ravel()
            _, group = np.unique(raw, return_inverse=True)
            by = np.lexsort((ids, group))
            g, i = group[by], ids[by]
            new = np.ones(len(by), bool)
            new[1:] = (g[1:] != g[:-1]) | (i[1:] != i[:-1])
            by, g = by[new], g[new]  # rows that repeat id and vector count once
            first = np.flatnonzero(np.diff(g, prepend=-1))
            nth = np.arange(len(by)) - np.repeat(first, np.diff(first, append=len(by)))
            use = np.sort(by[(nth <= k) | (ids[by] % every == 0)])
            x, ids = x[use], ids[use]
            d = pivot_distances(x, pivots)
            home = d.argmin(1)
            small = [pack(narrow(v)) for v in x]
            yield pa.RecordBatch.from_arrays([pa.array(home, pa.int32()), pa.array(d[np.arange(len(d)), home]), pa.array(ids), pa.array(small, pa.binary()), pa.array([r.tobytes() for r in d], pa.binary())], ["home", "away", "vec_id", "x", "d"])
            trim()

    return run


def _floors(x: np.ndarray, ids: np.ndarray, asked: np.ndarray, k: int) -> np.ndarray:
    """The k-th best score that each asked row has among the rows of its own chunk (none: minus infinity)."""
    out = np.full(len(asked), -np.inf)
    for n, i in enumerate(asked):
        other = ids != ids[i]
        scores, _ = top(products(x, x[i])[other], ids[other], k)
        if len(scores) == k:
            out[n] = scores[-1]
    return out


def _chunks(every: int, k: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, task, count = [], 0, TaskContext.get().partitionId(), 0

        def chunk() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            ids = t["vec_id"].to_numpy()
            x = np.stack([unpack(v.as_py()).astype(np.int64) for v in t["x"]])
            d = b"".join(t["d"].to_pylist())
            asked = np.flatnonzero(ids % every == 0)
            q = [ids[asked].tobytes(), pack(narrow(x[asked])), np.frombuffer(d, np.float32).reshape(len(ids), -1)[asked].tobytes(), _floors(x, ids, asked, k).tobytes()]
            cells = [ids.tobytes(), pack(narrow(x)), d, *q]
            return pa.RecordBatch.from_arrays([pa.array([(task << 33) + count]), *[pa.array([c], pa.binary()) for c in cells], pa.array([len(asked)])], _CHUNK_NAMES)

        for b in batches:
            for a in range(0, b.num_rows, size):
                piece = b.slice(a, size)
                while piece.num_rows:
                    held.append(piece.slice(0, size - n))
                    piece = piece.slice(len(held[-1]))
                    n += len(held[-1])
                    if n == size:
                        yield chunk()
                        held, n, count = [], 0, count + 1
        if n:
            yield chunk()
        trim()

    return run


_CHUNK_NAMES = ["chunk", "ids", "x", "d", "q_ids", "q_x", "q_d", "q_floor", "asked"]
_CHUNK = "chunk long, ids binary, x binary, d binary, q_ids binary, q_x binary, q_d binary, q_floor binary, asked long"


def _decode(row: dict, pivots: int, prefix: str = "") -> dict:
    ids = np.frombuffer(row[prefix + "ids"], np.int64)
    return {"ids": ids, "x": unpack(row[prefix + "x"]).astype(np.int64).reshape(len(ids), -1), "d": np.frombuffer(row[prefix + "d"], np.float32).reshape(len(ids), pivots)} | ({"floor": np.frombuffer(row["q_floor"])} if prefix else {})


def _queries(pivots: int, size: int):
    """Blocks of up to `size` queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, count, held, n = TaskContext.get().partitionId(), 0, [], 0

        def block(rows: list[dict]) -> pa.RecordBatch:
            c = {f: np.concatenate([r[f] for r in rows]) for f in ("ids", "x", "d", "floor")}
            return pa.RecordBatch.from_arrays([pa.array([(task << 33) + count]), *[pa.array([v], pa.binary()) for v in (c["ids"].tobytes(), pack(narrow(c["x"])), np.ascontiguousarray(c["d"]).tobytes(), c["floor"].tobytes())]], ["block", "q_ids", "q_x", "q_d", "q_floor"])

        for b in batches:
            for row in b.to_pylist():
                q = _decode(row, pivots, "q_")
                at = 0
                while at < len(q["ids"]):
                    take = slice(at, at + size - n)
                    held.append({f: v[take] for f, v in q.items()})
                    at, n = at + len(held[-1]["ids"]), n + len(held[-1]["ids"])
                    if n == size:
                        yield block(held)
                        held, n, count = [], 0, count + 1
        if n:
            yield block(held)

    return run


def _meet(pivots: int, k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for c in range(left.num_rows):
            chunk = _decode(left.slice(c, 1).to_pylist()[0], pivots)
            for b in range(right.num_rows):
                asked = _decode(right.slice(b, 1).to_pylist()[0], pivots, "q_")
                out += [(np.full(len(s), asked["ids"][i]), ids, s) for i, s, ids in evaluate(chunk, asked, k)[0]]
        trim()
        cols = [np.concatenate(v) for v in zip(*out)] if out else [np.zeros(0, np.int64)] * 3
        return pa.table(dict(zip(("query_id", "vec_id", "score"), cols)))

    return run


def search(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", *, every: int = 100, k: int = 10, scale: int = SCALE, pivots: int = PIVOTS, chunk_rows: int = CHUNK_ROWS, query_block: int = QUERY_BLOCK) -> DataFrame:
    """Each query's k highest inner products of whole-number vectors: query_id, rank (from 1), vec_id, score; exact.

    Queries: rows whose id is divisible by `every`; candidates: every row but those of the
    query's own id. Null ids take no part, nor do vectors that are null, hold null or non-finite
    components, whose dimension is not the most common one, or with a component so large that a
    product would not fit a long. Zero vectors do. Rows that repeat an id count once, at their
    best score, and ask with all their vectors. Ties go to the smaller id; fewer candidates than
    k: all of them. An empty table gives no rows.
    """
    spark = df.sparkSession
    rows, d, n = whole_vectors(df.where(F.col(id_col).isNotNull()), id_col, vector, scale)
    rows = rows.select("vec_id", "v")
    place = F.pmod(F.xxhash64("vec_id", F.lit(7)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    got = rows.withColumn("p", place).where(F.col("p") < min(1.0, 1.2 * SAMPLE / max(n, 1))).orderBy("p", "vec_id", "v").limit(SAMPLE).collect()
    chosen = choose_pivots(np.floor(np.array([r["v"] for r in got], np.float64).reshape(len(got), d) * scale).astype(np.int64), pivots)
    measured = rows.mapInArrow(_measure(chosen, scale, every, k), "home int, away float, vec_id long, x binary, d binary")
    by = ["home", "away", "vec_id"]
    chunks = cut(measured.repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(_chunks(every, k, chunk_rows), _CHUNK))
    size = chunks.agg(F.count("*").alias("chunks"), F.coalesce(F.sum("asked"), F.lit(0)).alias("asked")).first()
    n_chunks, n_blocks = max(1, size["chunks"]), max(1, -(-size["asked"] // query_block))
    blocks = cut(chunks.where("asked > 0").select("q_ids", "q_x", "q_d", "q_floor").repartition(n_blocks).mapInArrow(_queries(len(chosen), query_block), "block long, q_ids binary, q_x binary, q_d binary, q_floor binary"))
    spread = lambda to: F.explode(F.sequence(F.lit(0), F.lit(to - 1)))
    deal = lambda c, to: F.pmod(F.xxhash64(c), F.lit(to)).cast("int")
    left = chunks.select("chunk", "ids", "x", "d").withColumn("row", deal("chunk", n_chunks)).withColumn("col", spread(n_blocks))
    right = blocks.withColumn("col", deal("block", n_blocks)).withColumn("row", spread(n_chunks))
    found = left.groupBy("row", "col").cogroup(right.groupBy("row", "col")).applyInArrow(_meet(len(chosen), k), "query_id long, vec_id long, score long")
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark, sf_dir):
    """op13: rows of embeddings whose id is divisible by 100, against all rows."""
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE = """with v as (select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)) as v from embeddings
  where vec_id is not null and embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
 s as (select q.vec_id as query_id, c.vec_id, list_dot_product(q.v, c.v)::bigint as score from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 100 = 0)
select query_id, (row_number() over (partition by query_id order by score desc, vec_id))::int as rank, vec_id, score from s qualify rank <= 10"""
