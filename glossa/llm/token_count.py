"""Operator 5: token counts by rank-synchronous array merging.

Pre-tokens of a slab of documents become one ragged numpy array of symbols. In every round
each sequence finds its lowest-rank pair of neighbours and merges all places of that pair at
once; a pair that holds a merged symbol always ranks after it, so this gives exactly the
symbols of the usual one-at-a-time merging. What survives is counted, not decoded.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.llm.common import ragged, slabs, trim, whole_text

#: Fixed value: the pre-token pattern of byte-level BPE vocabularies of this kind.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NONE = np.int64(1 << 40)
CACHE = 400_000


class Merger:
    """A byte-level BPE vocabulary, as arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or (spec.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or spec.get("normalizer"):
            raise ValueError("a byte-level BPE file without a normaliser is needed")
        vocab = model["vocab"]
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
        letters = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(x for x in range(256) if x not in set(shown))}
        self.byte = np.array([vocab[letters[b]] for b in range(256)], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        code = np.array([vocab[a] << 20 | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(code, kind="stable")
        self.code, self.rank = code[order], order.astype(np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.special = sorted((t["content"] for t in spec.get("added_tokens", [])), key=len, reverse=True)  # the longest at a place wins
        self.split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.find = regex.compile(PATTERN).findall
        self.cache: dict[str, int] = {}

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        code = left << 20 | right
        at = np.minimum(np.searchsorted(self.code, code), len(self.code) - 1)
        return np.where(self.code[at] == code, self.rank[at], NONE)

    def lengths(self, tokens: list[str]) -> np.ndarray:
        """The number of symbols that each pre-token ends as."""
        raw = [t.encode("utf-8", "surrogatepass") for t in tokens]
        size = np.array([len(r) for r in raw], np.int64)
        out = size.copy()
        sym = self.byte[np.frombuffer(b"".join(raw), np.uint8)]
        seq = ragged(size)[0]
        names = np.arange(len(tokens))
        pair = np.full(len(sym), NONE)
        if len(sym) > 1:
            pair[:-1] = np.where(seq[1:] == seq[:-1], self.ranks(sym[:-1], sym[1:]), NONE)
        while len(sym):
            starts = np.flatnonzero(np.diff(seq, prepend=-1))
            low = np.minimum.reduceat(pair, starts)
            count = np.diff(starts, append=len(sym))
            live = low < NONE
            if not live.all():  # finished sequences leave the arrays
                out[names[seq[starts[~live]]]] = count[~live]
                keep = np.repeat(live, count)
                sym, seq, pair = sym[keep], seq[keep], pair[keep]
                count, low = count[live], low[live]
                if not len(sym):
                    break
            hit = pair == np.repeat(low, count)
            at = np.flatnonzero(hit)
            if len(at) > 1:  # in a run of places one apart (a a a), every second one merges
                new = np.diff(at, prepend=-2) != 1
                run = np.arange(len(at)) - np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
                at = at[run % 2 == 0]
            sym[at] = self.made[pair[at]]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            place = np.cumsum(keep) - 1
            sym, seq, pair = sym[keep], seq[keep], pair[keep]
            at = place[at]
            fresh = np.unique(np.concatenate([at, at[at > 0] - 1]))
            last = fresh == len(sym) - 1
            inner = fresh[~last]
            pair[inner] = np.where(seq[inner] == seq[inner + 1], self.ranks(sym[inner], sym[inner + 1]), NONE)
            pair[fresh[last]] = NONE
        return out

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each text; strings of special tokens in it count one each."""
        parts, extra = [], []
        for t in texts:
            pieces = self.split.split(t) if self.split and any(s in t for s in self.special) else [t]
            parts.append([x for p in pieces[::2] for x in self.find(p)] if len(pieces) > 1 else self.find(t))
            extra.append(len(pieces) // 2)
        new = list({x for p in parts for x in p}.difference(self.cache))
        if len(self.cache) + len(new) > CACHE:
            self.cache = {}
            new = list({x for p in parts for x in p})
        if new:
            self.cache.update(zip(new, self.lengths(new).tolist()))
        get = self.cache.__getitem__
        return [sum(map(get, p)) + e for p, e in zip(parts, extra)]


_mergers: dict[str, Merger] = {}


def merger(path: str) -> Merger:
    if path not in _mergers:
        _mergers[path] = Merger(path)
    return _mergers[path]


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text", limit: int = 512) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_tokens, over_limit. No shuffle.

    path: a byte-level BPE file that every executor can open. Null text counts as empty
    (0 tokens); repeated rows give repeated rows; an empty table gives none.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), whole_text(docs, text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = merger(path)
        for t in slabs(batches, "text", 1_000_000):
            texts = t["text"].to_pylist()
            n = pa.array(m.count(texts), pa.int64())
            size = pa.array([len(x.encode("utf-8", "surrogatepass")) for x in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([t["doc_id"].combine_chunks().cast(pa.int64()), size, n], ["doc_id", "n_bytes", "n_tokens"])
        m.cache = {}  # the worker lives on after the task
        trim()

    out = rows.withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


def query(spark, sf_dir, vocabulary: str = "byte_bpe_50k.json"):
    """op5: tokens of every whole document."""
    import public_tokenizers

    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path(vocabulary))
