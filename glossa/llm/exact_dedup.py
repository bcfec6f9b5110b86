"""Operator 1: exact deduplication by a Golomb-coded fingerprint exchange.

1. Each partition hashes its whole texts, keeps the sorted distinct fingerprints of a block of
   rows, and sends every owner (a range of the fingerprint space) the Golomb-Rice code of its
   part: a few bits a document instead of the document.
2. An owner decodes the blocks, finds fingerprints that more than one block holds or that a
   block marks as its own repeat, and answers each block with a bitmap.
3. Blocks read the bitmaps; only texts whose fingerprint is suspect are shuffled, and grouped
   by their bytes.

A fingerprint held by a third of all rows costs one entry a block, and its texts meet in a
partially aggregated group, so no task sees the copies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.llm.common import pack, rice_decode, rice_encode, spare, tasks_for, unpack, whole_text
from glossa.session import cut

#: Bits of fingerprint beyond log2(documents): one in 2**EXTRA_BITS unique texts is a false suspect, cleared by its bytes.
EXTRA_BITS = 14
#: Suspect fingerprints up to this many (8 bytes each) are broadcast to the scan; beyond it they are joined by a shuffle.
BROADCAST_ROWS = 4_000_000


def _blocks(batches: Iterator[pa.RecordBatch], bits: int, owners: int, block_rows: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    base, k = TaskContext.get().partitionId() << 24, 0
    held: list[np.ndarray] = []
    schema = pa.schema([("owner", pa.int32()), ("block", pa.int64()), ("code", pa.binary()), ("full", pa.binary())])

    def flush() -> pa.RecordBatch:
        nonlocal k
        full = np.sort(np.concatenate(held))
        held.clear()
        short = full >> np.uint64(64 - bits)
        first = np.concatenate([[True], short[1:] != short[:-1]])
        starts = np.flatnonzero(first)
        value, repeated = short[first], np.diff(starts, append=len(short)) > 1
        width = (1 << bits) // owners + 1
        owner = (value // np.uint64(width)).astype(np.int64)
        cuts = np.searchsorted(owner, np.arange(owners + 1))
        out = []
        for o in np.flatnonzero(np.diff(cuts)):
            a, b = cuts[o], cuts[o + 1]
            gaps = np.diff(value[a:b], prepend=np.uint64(o * width))
            par = max(0, int(np.log2(width / (b - a) * 0.7 + 1)))
            code = rice_encode(gaps, par)
            mine = full[starts[a] : starts[b] if b < len(starts) else len(full)]
            out.append((int(o), base + k, len(code).to_bytes(4, "little") + code + np.packbits(repeated[a:b]).tobytes(), pack(mine)))
        k += 1
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), schema)], schema=schema)

    n = 0
    for batch in batches:
        held.append(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
        n += batch.num_rows
        if n >= block_rows:
            yield flush()
            n = 0
    if n:
        yield flush()


def _own(owners: int, bits: int):
    def answer(key, pdf: pd.DataFrame) -> pd.DataFrame:
        width, o = (1 << bits) // owners + 1, int(key[0])
        lists, marks = [], []
        for raw in pdf["code"]:
            m = int.from_bytes(raw[:4], "little")
            v = np.cumsum(rice_decode(raw[4 : 4 + m])) + np.uint64(o * width)
            lists.append(v)
            marks.append(np.unpackbits(np.frombuffer(raw, np.uint8, offset=4 + m))[: len(v)].astype(bool))
        value, mark = np.concatenate(lists), np.concatenate(marks)
        order = np.argsort(value, kind="stable")
        s = value[order]
        same = np.concatenate([[False], s[1:] == s[:-1]])
        twice = same.copy()
        twice[:-1] |= same[1:]
        dup = np.zeros(len(value), bool)
        dup[order] = twice
        dup |= mark
        cuts = np.cumsum([len(v) for v in lists])[:-1]
        found = np.split(dup, cuts)
        return pd.DataFrame({"owner": np.int32(o), "block": pdf["block"].to_numpy(), "bitmap": [np.packbits(x).tobytes() for x in found], "hit": [bool(x.any()) for x in found]})

    return answer


def _suspects(bits: int):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw, bitmap in zip(batch.column("full").to_pylist(), batch.column("bitmap").to_pylist()):
                full = unpack(raw)
                short = full >> np.uint64(64 - bits)
                nth = np.cumsum(np.concatenate([[True], short[1:] != short[:-1]])) - 1
                hit = np.unpackbits(np.frombuffer(bitmap, np.uint8)).astype(bool)[nth]
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(full[hit]).view(np.int64))], ["fp"])

    return read


def suspect_fingerprints(hashes: DataFrame, rows: int, block_rows: int = 1 << 18) -> DataFrame:
    """Distinct values of the one long column of `hashes` that may occur in several rows (fp).

    No repeated value is missed. Owners grow with the rows, 2 million fingerprints each.
    """
    bits = min(62, max(8, int(np.ceil(np.log2(max(rows, 2)))) + EXTRA_BITS))
    owners = int(min(1 << (bits - 4), max(tasks_for(hashes.sparkSession), rows // 2_000_000 + 1)))
    schema = "owner int, block long, code binary, full binary"
    blocks = cut(hashes.mapInArrow(lambda b: _blocks(b, bits, owners, block_rows), schema))
    replies = blocks.select("owner", "block", "code").groupBy("owner").applyInPandas(_own(owners, bits), "owner int, block long, bitmap binary, hit boolean")
    home = blocks.select("owner", "block", "full").join(replies.where("hit").drop("hit"), ["owner", "block"])
    return home.select("full", "bitmap").mapInArrow(_suspects(bits), "fp long").distinct()


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes are (null: empty, equal to the empty text). Of equal texts
    the row with the largest id stays (a null id is below all others; of rows that repeat one
    id and text exactly one stays). An empty table gives no rows.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), whole_text(docs, text).alias("text"))
    source = source.withColumn("fp", F.xxhash64("text"))
    base = cut(source.select("doc_id", "fp", F.unhex(F.sha2("text", 256)).alias("sha")).withColumn("uid", F.monotonically_increasing_id()))
    n = base.count()
    suspects = cut(suspect_fingerprints(base.select("fp"), n))
    few = suspects.count() <= BROADCAST_ROWS
    texts = source.select("fp", "text").join(F.broadcast(suspects) if few else suspects, "fp", "left_semi")
    groups = texts.groupBy("fp", "text").agg(F.count("*").alias("group_size")).where("group_size > 1")
    groups = groups.select("fp", F.unhex(F.sha2("text", 256)).alias("sha"), "group_size")
    best = base.join(F.broadcast(suspects) if few else suspects, "fp", "left_semi").groupBy("fp", "sha").agg(F.max(F.struct("doc_id", "uid")).alias("top"))
    chosen = cut(groups.join(best, ["fp", "sha"]))  # a table of its own, so that the join below may split a hot group
    out = base.join(chosen, ["fp", "sha"], "left")
    return out.select(
        "doc_id", F.when(F.col("top").isNotNull(), F.col("top.doc_id")).otherwise(F.col("doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("top").isNull() | (F.col("top.uid") == F.col("uid"))).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs, all columns, that exact_dedup keeps. Text that stays is not shuffled (but for rows that repeat a kept one)."""
    found = cut(exact_dedup(docs, id_col, text).where("not kept").select("doc_id", "keep_id", "text_sha256"))
    same_row = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    own, dropped, sha = spare(docs, "__id", "__dropped", "__sha")

    def ids(df: DataFrame) -> DataFrame:
        df = df.select(F.col("doc_id").alias(own), F.col("text_sha256").alias(dropped)).distinct()
        return F.broadcast(df) if found.count() <= BROADCAST_ROWS // 8 else df

    keyed = docs.withColumn(sha, F.sha2(whole_text(docs, text), 256))
    is_in = F.col(id_col).eqNullSafe(F.col(own)) & (F.col(sha) == F.col(dropped))
    kept = keyed.join(ids(found.where(~same_row)), is_in, "left_anti")
    repeats = found.where(same_row)
    if not repeats.isEmpty():
        once = kept.join(ids(repeats), is_in, "left_semi").dropDuplicates([id_col, sha])
        kept = kept.join(ids(repeats), is_in, "left_anti").unionByName(once)
    return kept.drop(sha)


ORACLE = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
       sha256(COALESCE(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY COALESCE(text, ''))
"""


def query(spark, sf_dir):
    """op1: all documents."""
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
