"""Operator 4: a quality classifier.

Document statistics, random Fourier features of a Gaussian kernel over them, ridge
regression from normal equations that partitions sum, and isotonic calibration on labelled
rows that the regression did not see. Text is read once for the statistics; tasks sum their
matrices in slices, so one D x D matrix reaches the driver, whatever the input.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.llm.common import by_bytes, crc_mod, find_words, lower, ragged, slices, span_hash, summed, tasks_for, text_bytes, whole_text
from glossa.session import cut

#: Labelled rows that one task sums, and slices in which tasks' sums are added.
FIT_ROWS, SLICES = 20_000, 16
#: Bytes of text whose statistics are taken at a time; labelled ids (16 bytes each) that are broadcast, beyond which they are not used to skip texts.
SLAB_BYTES, BROADCAST_ROWS = 1_000_000, 1_000_000
#: Fourier features, and bins of the calibration's histogram.
FEATURES, BINS = 256, 4096
_KIND = np.full(256, 7, np.uint8)  # other symbols
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[128:] = 0, 1, 2, 3
_KIND[[32, 9, 11, 12, 13]], _KIND[10] = 4, 5
for _c in b".,;:?'\"()-":
    _KIND[_c] = 6
_KINDS = 8
N_STATS = 20


def statistics(column: pa.Array) -> np.ndarray:
    """(rows, N_STATS) numbers about the whole texts; an empty text gives zeros."""
    data, off = text_bytes(column)
    rows, size = len(off) - 1, np.diff(off)
    x = np.zeros((rows, N_STATS))
    if not len(data):
        return x
    row = ragged(size)[0]
    share = np.bincount(row * _KINDS + _KIND[data], minlength=rows * _KINDS).reshape(rows, _KINDS) / np.maximum(size, 1)[:, None]
    start, end, before = find_words(data, off)
    n = np.diff(before)
    one = np.maximum(n, 1)
    w_row, length = ragged(n)[0], (end - start).astype(float)

    def per_row(v: np.ndarray) -> np.ndarray:
        return np.bincount(w_row, v, minlength=rows) / one

    mean = per_row(length)
    h = span_hash(lower(data), start, end)
    key = np.sort((w_row.astype(np.uint64) << np.uint64(40)) | (h >> np.uint64(24)))
    first = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.zeros(0, bool)
    runs = np.diff(np.flatnonzero(first), append=len(key))
    most = np.zeros(rows)
    np.maximum.at(most, w_row[first], runs)
    nl = np.flatnonzero(data == 10)
    line_start = np.union1d(off[:-1][size > 0], nl + 1)
    line_start = line_start[line_start < len(data)]
    line_row = row[line_start]
    line_end = np.minimum(np.append(line_start[1:], len(data)), off[1:][line_row])
    line_end -= (line_end > line_start) & (data[line_end - 1] == 10)
    full = line_end > line_start
    line_row, lh = line_row[full], span_hash(data, line_start[full], line_end[full])
    lines = np.bincount(line_row, minlength=rows)
    distinct = np.bincount((np.unique((line_row.astype(np.uint64) << np.uint64(40)) | (lh >> np.uint64(24))) >> np.uint64(40)).astype(np.int64), minlength=rows)
    head, tail = _KIND[data[start]], _KIND[data[end - 1]]
    x[:, :_KINDS] = share
    x[:, 8], x[:, 9], x[:, 10] = np.log1p(size), np.log1p(n), np.minimum(mean, 50)
    x[:, 11] = np.minimum(np.sqrt(np.maximum(per_row(length**2) - mean**2, 0)), 50)
    x[:, 12] = np.bincount(w_row[first], minlength=rows) / np.sqrt(one)
    x[:, 13] = most / one
    x[:, 14] = np.where(lines > 0, 1 - distinct / np.maximum(lines, 1), 0)
    x[:, 15] = np.log1p(size / np.maximum(lines, 1))
    x[:, 16], x[:, 17] = per_row(head == 1), per_row(tail == 7)
    x[:, 18], x[:, 19] = per_row(length <= 2), per_row((length == 1) & (head == 7))
    return x


@dataclass(frozen=True)
class Model:
    """A fitted classifier; small, so it travels inside task closures."""

    mean: np.ndarray
    scale: np.ndarray
    beta: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def raw(self, x: np.ndarray) -> np.ndarray:
        return _fourier((x - self.mean) / self.scale) @ self.beta

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), self.knots, self.values), 0.0, 1.0)


def _fourier(z: np.ndarray) -> np.ndarray:
    rng = np.random.default_rng(20)
    w = rng.standard_normal((N_STATS, FEATURES)) / (0.8 * np.sqrt(N_STATS))
    b = rng.uniform(0, 2 * np.pi, FEATURES)
    z = np.clip(z, -6, 6)
    return np.hstack([np.sqrt(2 / FEATURES) * np.cos(z @ w + b), z / 6, np.ones((len(z), 1))])


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("x").to_pylist()), np.float64).reshape(-1, N_STATS)


def _sums(df: DataFrame, of) -> np.ndarray:
    """The sum over all rows of of(x, y), an array: summed in tasks, then in slices over all tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for b in batches:
            if b.num_rows:
                total = total + of(_matrix(b), b.column("y").to_numpy(zero_copy_only=False).astype(float))
        if not isinstance(total, int):
            yield slices(total, SLICES)

    return summed(df.mapInArrow(run, "slice int, s binary"), SLICES)


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, x): the statistics of each row's whole text as packed doubles."""

    @F.arrow_udf("binary")
    def stats(column: pa.Array) -> pa.Array:
        return pa.array([r.tobytes() for part in by_bytes(column, SLAB_BYTES) for r in statistics(part)], pa.binary())

    return docs.select(F.col(id_col).alias("doc_id"), stats(whole_text(docs, text)).alias("x"))


def fit(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label: str = "quality", held_out: int = 0, folds: int = 5, ridge: float = 1e-3) -> Model:
    """Fits on labelled rows outside the fold held_out; the fold after it calibrates.

    A null label is no label; an id labelled twice counts twice. Without labelled rows every
    score is 0.5; with labels of one kind it is that label.
    """
    train = stats.join(labels.select(F.col(id_col).alias("doc_id"), F.col(label).cast("double").alias("y")).where("y is not null"), "doc_id")
    train = train.withColumn("fold", crc_mod("doc_id", folds)).where(F.col("fold") != held_out)
    train = cut(train)
    train = train.repartition(max(1, min(train.count() // FIT_ROWS + 1, tasks_for(stats.sparkSession))))
    m = _sums(train, lambda x, y: np.concatenate([[len(y), y.sum()], x.sum(0), (x * x).sum(0)]))
    if not len(m) or m[1] in (0, m[0]):
        value = 0.5 if not len(m) else m[1] / m[0]
        return Model(np.zeros(N_STATS), np.ones(N_STATS), np.zeros(FEATURES + N_STATS + 1), np.zeros(1), np.full(1, value))
    mean = m[2 : 2 + N_STATS] / m[0]
    scale = np.sqrt(np.maximum(m[2 + N_STATS :] / m[0] - mean**2, 0))
    scale = np.where(scale > 1e-9, scale, 1.0)
    d = FEATURES + N_STATS + 1

    def normal(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        p = _fourier((x - mean) / scale)
        return np.concatenate([(p.T @ p).ravel(), p.T @ y])

    calibrate = (held_out + 1) % folds
    s = _sums(train.where(F.col("fold") != calibrate), normal)
    if not len(s):
        s = _sums(train, normal)
    beta = np.linalg.solve(s[: d * d].reshape(d, d) + ridge * m[0] / d * np.eye(d), s[d * d :])
    raw = Model(mean, scale, beta, np.zeros(1), np.zeros(1))
    lo, hi = -0.5, 1.5

    def bins(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        k = np.clip((raw.raw(x) - lo) / (hi - lo) * BINS, 0, BINS - 1).astype(int)
        return np.concatenate([np.bincount(k, minlength=BINS), np.bincount(k, y, minlength=BINS)])

    h = _sums(train.where(F.col("fold") == calibrate), bins)
    h = h if len(h) else _sums(train, bins)
    knots, values = isotonic(lo + (np.arange(BINS) + 0.5) * (hi - lo) / BINS, h[:BINS], h[BINS:])
    return Model(mean, scale, beta, knots, values)


def isotonic(at: np.ndarray, count: np.ndarray, ones: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The non-decreasing least-squares fit of ones/count (pool adjacent violators), as knots and values."""
    pools: list[list[float]] = []
    for a, n, s in zip(at[count > 0], count[count > 0], ones[count > 0]):
        pools.append([n, s, a * n])
        while len(pools) > 1 and pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0]:
            n2, s2, a2 = pools.pop()
            pools[-1] = [pools[-1][0] + n2, pools[-1][1] + s2, pools[-1][2] + a2]
    return np.array([p[2] / p[0] for p in pools]), np.array([p[1] / p[0] for p in pools])


def score_text(model: Model, column):
    """A column of scores of whole texts (null: as the empty text)."""

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        parts = [model.score(statistics(part)) for part in by_bytes(texts, SLAB_BYTES)]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.float64())

    return score(F.coalesce(column, F.lit("")))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", threshold: float = 0.3) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted. Null or empty texts get a score too.

    Rows that repeat get the same score; an empty table gives no rows.
    """
    stats = cut(document_statistics(docs, id_col, text))
    model = fit(stats, labels, id_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(model.score(_matrix(b)))], ["doc_id", "held_out", "score"])

    kind = stats.schema["doc_id"].dataType.simpleString()
    out = stats.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "x").mapInArrow(run, f"doc_id {kind}, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of docs, all columns, that the classifier does not reject. Text is scored in place and not shuffled.

    Null and empty texts have a score like all others, repeated rows the same one, so rows of any
    id, null included, stay or go by their text; an empty table gives none. The fit takes the
    statistics of labelled documents only, if their ids are few enough to be broadcast.
    """
    ids = labels.select(F.col(id_col)).distinct()
    few = ids.count() <= BROADCAST_ROWS
    model = fit(cut(document_statistics(docs.join(F.broadcast(ids), id_col, "left_semi") if few else docs, id_col, text)), labels, id_col)
    return docs.where(score_text(model, F.col(text)) >= threshold)


def query(spark, sf_dir):
    """op4: every document, by the labels of the folds that are not held out."""
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
