"""Operator 11: vectors as short codes, by Lloyd rounds with Hamerly's bounds.

Vectors become whole numbers, cut into equal parts; each part position has a codebook. The
first pass packs rows in blocks and assigns every part by a full scan. Each block keeps, for
every part, its code, one upper bound of the distance to its entry and one lower bound of the
distance to the second-nearest entry. When entries move, both bounds move with them; only where
the upper bound is not strictly below the lower one (or half the way to the nearest other entry)
is the own distance computed anew, and if that is not strictly below either, all entries are
compared in integers, ties to the lower index. Bounds are rounded outwards, so a part that is
left alone has a strictly nearest entry and the codes are those of full scans.

A round reads one written table of blocks and writes the next, with the sums of each block
beside it; the sums alone are read and added up by place, so the driver gets a codebook's
numbers and nothing that grows with the rows. The table before is removed then.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glossa.llm.common import pack, trim, unpack
from glossa.llm.vectors import narrow, whole, whole_vectors
from glossa.session import cut, ensure_checkpoint_dir, remove

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Rows of a block: what a task holds at once.
BLOCK_ROWS = 4096
#: A label that at least one in so many rows has is joined by broadcast (there are no more than this), others by a shuffle.
COMMON = 1000
#: Outward rounding of a bound, far above the rounding of doubles.
WIDEN = 2.0**-40


@dataclass(frozen=True)
class Codebooks:
    """Whole-number entries by part, entry and place within the part."""

    scale: int
    entries: np.ndarray

    def digest(self) -> str:
        """sha256 of all components, decimal, joined by commas."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    def decode(self, code: str) -> np.ndarray:
        """The vector that a code stands for."""
        at = np.frombuffer(bytes.fromhex(code), np.uint8)
        return (self.entries[np.arange(len(at)), at].ravel() + 0.5) / self.scale


def scan(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For rows of one part: the nearest entry (ties: lower index), its squared distance, and the second smallest (-1: none)."""
    d = np.empty((len(x), len(entries)), np.int64)
    for k, e in enumerate(entries):
        d[:, k] = ((x - e) ** 2).sum(1)
    code = d.argmin(1)
    second = np.partition(d, 1, axis=1)[:, 1] if d.shape[1] > 1 else np.full(len(d), -1)
    return code, d[np.arange(len(d)), code], second


def _root_up(d: np.ndarray) -> np.ndarray:
    return np.sqrt(d.astype(np.float64)) * (1 + WIDEN)


def _root_down(d: np.ndarray) -> np.ndarray:
    return np.where(d < 0, np.inf, np.sqrt(np.maximum(d, 0).astype(np.float64)) * (1 - WIDEN))


@dataclass
class Bounds:
    """Of rows by part: codes, and the bounds of nearest and second-nearest distance as single floats rounded outwards."""

    code: np.ndarray
    upper: np.ndarray
    lower: np.ndarray

    def put(self, rows: np.ndarray, part: int, upper: np.ndarray, lower: np.ndarray | None = None) -> None:
        self.upper[rows, part] = np.nextafter(upper.astype(np.float32), np.float32(np.inf))
        if lower is not None:
            self.lower[rows, part] = np.maximum(np.nextafter(lower.astype(np.float32), np.float32(-np.inf)), 0)


def assign(x: np.ndarray, entries: np.ndarray) -> Bounds:
    """All parts of all rows by full scans. x: rows, parts, width."""
    n, parts, _ = x.shape
    b = Bounds(np.zeros((n, parts), np.uint8), np.zeros((n, parts), np.float32), np.zeros((n, parts), np.float32))
    for p in range(parts):
        code, d, second = scan(x[:, p], entries[p])
        b.code[:, p] = code
        b.put(np.arange(n), p, _root_up(d), _root_down(second))
    return b


def reassign(x: np.ndarray, b: Bounds, old: np.ndarray, new: np.ndarray) -> int:
    """Bring codes and bounds from the old entries to the new ones; the number of full scans that it took."""
    scans = 0
    for p in range(x.shape[1]):
        moved = _root_up(((new[p] - old[p]) ** 2).sum(1))
        by = np.argsort(-moved, kind="stable")
        others = np.full(len(moved), moved[by[0]])
        others[by[0]] = moved[by[1]] if len(by) > 1 else 0.0
        apart = ((new[p][:, None] - new[p][None]) ** 2).sum(2)
        np.fill_diagonal(apart, np.iinfo(np.int64).max)
        half = _root_down(apart.min(1)) / 2 if len(by) > 1 else np.full(1, np.inf)
        code = b.code[:, p]
        upper = (b.upper[:, p].astype(np.float64) + moved[code]) * (1 + WIDEN)
        lower = np.maximum((b.lower[:, p].astype(np.float64) - others[code]) * (1 - WIDEN), 0)
        b.put(np.arange(len(x)), p, upper, lower)
        safe = np.maximum(lower, half[code])
        loose = np.flatnonzero(~(upper < safe))
        if len(loose):
            own = _root_up(((x[loose, p] - new[p][code[loose]]) ** 2).sum(1))
            b.put(loose, p, own)
            full = loose[~(own < safe[loose])]
            found, d, second = scan(x[full, p], new[p])
            b.code[full, p] = found
            b.put(full, p, _root_up(d), _root_down(second))
            scans += len(full)
    return scans


def _sums(x: np.ndarray, code: np.ndarray, k: int) -> np.ndarray:
    """Parts, entries, components and a count at their end; exact, as a block's sums stay far below 2**53."""
    n, parts, width = x.shape
    out = np.zeros((parts, k, width + 1), np.int64)
    for p in range(parts):
        out[p, :, width] = np.bincount(code[:, p], minlength=k)
        for j in range(width):
            out[p, :, j] = np.bincount(code[:, p], x[:, p, j], k)
    return out


def moved_entries(entries: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Componentwise floor of the means; entries without parts stay."""
    count = sums[..., -1:]
    return np.where(count > 0, sums[..., :-1] // np.maximum(count, 1), entries)


_BLOCK = "x binary, code binary, upper binary, lower binary, sums binary, scans long"


def _block(rows: pa.Array, x: np.ndarray, b: Bounds, k: int, scans: int) -> pa.RecordBatch:
    parts = [pack(narrow(x)), b.code.tobytes(), b.upper.tobytes(), b.lower.tobytes(), _sums(x, b.code, k).tobytes()]
    return pa.RecordBatch.from_arrays([rows, *[pa.array([v], pa.binary()) for v in parts], pa.array([scans], pa.int64())], ["rows", "x", "code", "upper", "lower", "sums", "scans"])


def _pack(entries: np.ndarray, scale: int, size: int):
    parts, k, width = entries.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole_batch in batches:
            for a in range(0, whole_batch.num_rows, size):
                b = whole_batch.slice(a, size)
                items = pa.StructArray.from_arrays([b.column("vec_id"), b.column("kept")], ["vec_id", "kept"])
                x = whole(b.column("v"), scale).reshape(-1, parts, width)
                yield _block(pa.ListArray.from_arrays(pa.array([0, len(items)], pa.int32()), items), x, assign(x, entries), k, len(x) * parts)
            trim()

    return run


def _blocks(batches: Iterator[pa.RecordBatch], parts: int, width: int) -> Iterator[tuple[pa.Array, np.ndarray, Bounds]]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1)
            raw = {c: row.column(c)[0].as_buffer() for c in ("x", "code", "upper", "lower")}
            x = unpack(raw["x"].to_pybytes()).astype(np.int64).reshape(-1, parts, width)
            of = lambda c, t: np.frombuffer(raw[c], t).reshape(-1, parts).copy()
            yield row.column("rows"), x, Bounds(of("code", np.uint8), of("upper", np.float32), of("lower", np.float32))
        trim()


def _round(old: np.ndarray, new: np.ndarray):
    parts, k, width = new.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, x, b in _blocks(batches, parts, width):
            scans = reassign(x, b, old, new)
            yield _block(rows, x, b, k, scans)

    return run


def _last(old: np.ndarray, new: np.ndarray):
    """Final codes as hex and the squared distances, summed over parts."""
    parts, _, width = new.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, x, b in _blocks(batches, parts, width):
            reassign(x, b, old, new)
            error = ((x - new[np.arange(parts)[None], b.code]) ** 2).sum((1, 2))
            text = b.code.tobytes().hex()
            items = rows.flatten()
            yield pa.RecordBatch.from_arrays([items.field("vec_id"), items.field("kept"), pa.array([text[i : i + 2 * parts] for i in range(0, len(text), 2 * parts)], pa.string()), pa.array(error, pa.int64())], ["vec_id", "kept", "code", "error"])

    return run


def _added(blocks: DataFrame, shape: tuple[int, ...]) -> np.ndarray:
    """The blocks' sums, added up in each task and then by place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for raw in b.column(0):
                s = np.frombuffer(raw.as_buffer(), np.int64)
                total = s.copy() if total is None else total + s
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total)], ["at", "s"])

    out = np.zeros(int(np.prod(shape)), np.int64)
    for r in blocks.select("sums").mapInArrow(run, "at int, s long").groupBy("at").agg(F.sum("s").alias("s")).collect():
        out[r["at"]] = r["s"]
    return out.reshape(shape)


def compress(
    df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", keep: tuple[str, ...] = (), *, scale: int = SCALE, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, block_rows: int = BLOCK_ROWS, report: list[int] | None = None
) -> tuple[DataFrame, Codebooks]:
    """((vec_id, kept, code, error), codebooks): each vector's entries in hex, and its squared error in whole numbers.

    Codebooks start as the parts of the `entries` rows of smallest id (at most 256), fewer if the
    table has fewer; rows of one id by their vectors, null ids last. kept is a struct of the
    columns named in keep, whatever their names. Null and repeated ids are rows like others.
    Vectors that are null, hold null or non-finite components, whose dimension is not the most
    common multiple of `parts`, or with a component so large that squared errors would not fit a
    long, take no part. Zero vectors do. An empty table gives no rows and empty codebooks.
    report, if given, gets the number of full scans of each round.
    """
    spark = df.sparkSession
    rows, d, _ = whole_vectors(df, id_col, vector, scale, keep, parts)
    width = d // parts
    first = [r["v"] for r in rows.select("vec_id", "v").orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()]
    start = np.floor(np.array(first, np.float64).reshape(len(first), d) * scale).astype(np.int64)
    books = start.reshape(len(first), parts, width).transpose(1, 0, 2).copy()
    out = T.StructType([rows.schema["vec_id"], rows.schema["kept"], T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    if not first:
        return spark.createDataFrame([], out), Codebooks(scale, books)
    block = T.StructType([T.StructField("rows", T.ArrayType(T.StructType([rows.schema["vec_id"], rows.schema["kept"]]))), *T.StructType.fromDDL(_BLOCK).fields])
    folder = f"{ensure_checkpoint_dir(spark)}/codes-{uuid.uuid4().hex}"
    step, before = rows.mapInArrow(_pack(books, scale, block_rows), block), books
    for k in range(rounds):
        step.write.parquet(f"{folder}/{k}")
        table = spark.read.schema(block).parquet(f"{folder}/{k}")
        if report is not None:
            report.append(table.agg(F.sum("scans")).first()[0])
        before, books = books, moved_entries(books, _added(table, (parts, len(first), width + 1)))
        if k:
            remove(spark, f"{folder}/{k - 1}")
        step = table.mapInArrow(_round(before, books), block)
    done = cut(table.mapInArrow(_last(before, books), out))
    remove(spark, folder)
    return done, Codebooks(scale, books)


def with_label_error(codes: DataFrame, label: str) -> DataFrame:
    """codes with label_error: the errors summed over rows of an equal kept label, nulls together (null: no long holds the sum).

    Sums are made before the shuffle. Labels of a thousandth of all rows or more, at most a
    thousand, come back by broadcast, so no hot label is shuffled; the others by a join.
    """
    of = codes.select("*", F.col(f"kept.`{label}`").isNull().alias("no_label"), F.col(f"kept.`{label}`").alias("label"))
    key = ["no_label", "label"]
    sums = cut(of.groupBy(*key).agg(F.try_sum("error").alias("label_error"), F.count("*").alias("n")))
    n = sums.agg(F.sum("n")).first()[0] or 0
    hot = sums.where(F.col("n") * COMMON >= n)
    rare = sums.where(F.col("n") * COMMON < n)

    def joined(rows: DataFrame, to: DataFrame) -> DataFrame:
        to = to.select(F.col("no_label").alias("no_label_"), F.col("label").alias("label_"), "label_error")
        return rows.join(to, (F.col("no_label") == F.col("no_label_")) & F.col("label").eqNullSafe(F.col("label_"))).drop("no_label_", "label_")

    found = joined(of, F.broadcast(hot))
    if not rare.isEmpty():
        mine = F.broadcast(hot.select(F.col("label").alias("label_")))
        found = found.unionByName(joined(of.join(mine, F.col("label").eqNullSafe(F.col("label_")), "left_anti"), rare))
    return found.drop(*key)


def query(spark, sf_dir):
    """op11: embeddings as eight-byte codes, their errors, and the digest of the codebooks."""
    codes, books = compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), keep=("label",))
    return with_label_error(codes, "label").select("vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))


def _oracle() -> str:
    """The same rounds by full scans, one common table each."""
    sql = """with kept as materialized (select row_number() over (order by vec_id nulls last, embedding) as r, vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::double)::bigint) as v
  from embeddings where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
 x as materialized (select r, (i - 1) // (len(v) // 8) as part, (i - 1) % (len(v) // 8) as j, v[i] as c from (select r, v, unnest(range(1, len(v) + 1)) as i from kept)),
 b0 as materialized (select part, r - 1 as entry, j, c from x where r <= 16)"""
    for k in range(7):
        sql += f""",
 d{k} as materialized (select r, part, entry, sum((x.c - b.c) * (x.c - b.c))::bigint as d from x join b{k} b using (part, j) group by all),
 a{k} as materialized (select r, part, entry, d from d{k} qualify row_number() over (partition by r, part order by d, entry) = 1)"""
        if k < 6:
            sql += f""",
 s{k} as (select part, entry, j, sum(c)::bigint as s, count(*)::bigint as n from x join a{k} using (r, part) group by all),
 b{k + 1} as materialized (select part, entry, j, coalesce((s - ((s % n) + n) % n) // n, c) as c from b{k} left join s{k} using (part, entry, j))"""
    return sql + """,
 codes as (select r, string_agg(format('{:02x}', entry), '' order by part) as code, sum(d)::bigint as error from a6 group by r),
 sha as (select sha256(string_agg(c::varchar, ',' order by part, entry, j)) as h from b6)
select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, (select h from sha) as codebooks_sha256 from codes join kept using (r)"""


ORACLE = _oracle()
