"""Operator 7: language identification with a linear-chain conditional random field.

Words carry affix, n-gram and lexicon features; learned transitions let the language change
inside a text. Forward-backward gives each word its label's probability, so code-switched
passages are found; a document's language is the one with the most expected words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glossa.llm.chain import posteriors
from glossa.llm.common import crc_mod, find_words, lower, mix, ragged, slabs, span_hash, text_bytes, whole_text
from glossa.session import cut

#: Labelled documents of each language that the model is fitted on, of at most SAMPLE_CHARS characters each; fewer languages than rows, so the bound holds at any size.
SAMPLE_PER_LANGUAGE, SAMPLE_CHARS = 250, 200_000
#: Languages whose samples' ends (a name and a number) are broadcast; more are joined by a shuffle.
BROADCAST_LANGUAGES = 10_000
#: Feature weights are hashed into this many slots.
SLOTS = 1 << 17
ROUNDS = 24
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


def unique_words(column: pa.Array):
    """(ids, before, bytes, start, end, n): word numbers of all positions, and where each distinct word stands."""
    data, off = text_bytes(column)
    data = lower(data)
    start, end, before = find_words(data, off)
    _, first, ids = np.unique(span_hash(data, start, end), return_index=True, return_inverse=True)
    return ids, before, data, start[first], end[first]


def word_features(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slots of the features of each distinct word, and where each word's slots start."""
    n = end - start
    # a copy of the words with a zero byte on either side; trigrams cover 2-byte affixes through it
    word, place = ragged(n + 2)
    src = start[word] + place - 1
    edge = (place == 0) | (place == n[word] + 1)
    text = np.where(edge, 0, data[np.clip(src, 0, max(len(data) - 1, 0))]).astype(np.uint64) if len(word) else np.zeros(0, np.uint64)
    inner = place < n[word]
    i = np.flatnonzero(inner)
    tri = text[i] << np.uint64(16) | text[i + 1] << np.uint64(8) | text[i + 2]
    tri_word = word[i]
    w = np.arange(len(n))
    more = [span_hash(data, start, end)]  # the lexicon
    for k in (1, 3, 4):
        more.append(span_hash(data, start, np.minimum(start + k, end)) + np.uint64(2 * k))
        more.append(span_hash(data, np.maximum(end - k, start), end) + np.uint64(2 * k + 1))
    ids = np.concatenate([mix(tri + np.uint64(1 << 60)), *more])
    owner = np.concatenate([tri_word, *[w] * len(more)])
    order = np.argsort(owner, kind="stable")
    slots = (ids[order] & np.uint64(SLOTS - 1)).astype(np.int64)
    return slots, np.searchsorted(owner[order], w)


@dataclass(frozen=True)
class Crf:
    languages: tuple[str, ...]
    weights: np.ndarray  # (SLOTS, K), single precision
    transitions: np.ndarray

    def emissions(self, slots: np.ndarray, first: np.ndarray) -> np.ndarray:
        return _emissions(self.weights, slots, first)


def _emissions(weights: np.ndarray, slots: np.ndarray, first: np.ndarray) -> np.ndarray:
    if not len(first):
        return np.ones((0, weights.shape[1]))
    s = np.add.reduceat(weights[slots], first, axis=0).astype(float)
    return np.exp(np.clip(s - s.max(1, keepdims=True), -40, 0))


def train(texts: list[str], labels: list[str]) -> Crf:
    """Maximum likelihood with a Gaussian prior, by adaptive gradient steps."""
    names = tuple(sorted(set(labels)))
    k = len(names)
    ids, before, data, start, end = unique_words(pa.array(texts, pa.string()))
    slots, first = word_features(data, start, end)
    y = np.repeat(np.array([names.index(x) for x in labels], np.int64), np.diff(before))
    weights, step = np.zeros((SLOTS, k), np.float32), np.full((SLOTS, k), 1e-4, np.float32)
    trans, t_step = np.where(np.eye(k, dtype=bool), 2.0, 0.0), np.full((k, k), 1e-4)
    owner = np.repeat(np.arange(len(first)), np.diff(first, append=len(slots)))
    seen = np.bincount(ids * k + y, minlength=len(first) * k).reshape(-1, k).astype(float) if len(ids) else np.zeros((0, k))
    doc_y = np.array([names.index(x) for x in labels])
    same = np.diag(np.bincount(doc_y, np.maximum(np.diff(before) - 1, 0), minlength=k))
    weigh = 1.0 / np.maximum(np.bincount(y, minlength=k), 1) * len(y) / k  # languages weigh alike
    for _ in range(ROUNDS if len(ids) and k > 1 else 0):
        gamma, xi, _lik = posteriors(_emissions(weights, slots, first)[ids], before, np.exp(trans), np.full(k, 1.0 / k))
        expected = np.stack([np.bincount(ids, gamma[:, j] * weigh[y], minlength=len(first)) for j in range(k)], 1)
        g_word = (seen * weigh[None] - expected)[owner]
        g = np.stack([np.bincount(slots, g_word[:, j], minlength=SLOTS) for j in range(k)], 1).astype(np.float32) - 0.05 * weights
        step += g * g
        weights += np.float32(0.3) * g / np.sqrt(step)
        g_t = same - xi - 0.5 * trans
        t_step += g_t * g_t
        trans += 0.3 * g_t / np.sqrt(t_step)
        trans = np.clip(trans, -3, 3)  # a switch stays possible though labels are one to a document
    return Crf(names, weights, np.exp(trans))


def label_words(model: Crf, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(probabilities (words, K), words before each text, whether each word holds a letter)."""
    ids, before, data, start, end = unique_words(column)
    e = model.emissions(*word_features(data, start, end))
    count = np.concatenate([[0], np.cumsum(_LETTER[data])])
    letter = (count[end] - count[start] > 0)[ids] if len(ids) else np.zeros(0, bool)
    k = len(model.languages)
    gamma = posteriors(e[ids], before, model.transitions, np.full(k, 1.0 / k))[0] if len(ids) else np.zeros((0, k))
    return gamma, before, letter


def sample_labelled(docs: DataFrame, id_col: str, text: str, lang: str, held: int, folds: int, per_language: int) -> list:
    """per_language labelled documents of each language (all, if it has fewer), whole: the first by a hash of id and text.

    Ids may be null or repeat; rows equal in id and text count as often as they occur. A first
    pass over hashes alone finds how far each language's sample reaches.
    """
    usable = docs.where((crc_mod(id_col, folds) != held) & F.col(lang).isNotNull() & F.col(text).isNotNull()).where(F.length(text) <= SAMPLE_CHARS)
    usable = usable.select(F.col(id_col).alias("id"), F.col(lang).alias("lang"), F.col(text).alias("text")).withColumn("place", F.xxhash64(F.lit(7), "id", "text"))
    first = lambda *by: F.row_number().over(W.partitionBy("lang").orderBy(*by))
    reach = usable.select("lang", "place").withColumn("nth", first("place")).where(F.col("nth") <= per_language)
    reach = cut(reach.groupBy("lang").agg(F.max("place").alias("last")))
    few = reach.count() <= BROADCAST_LANGUAGES
    near = usable.join(F.broadcast(reach) if few else reach, "lang").where(F.col("place") <= F.col("last"))
    return near.withColumn("nth", first("place", "id", "text")).where(F.col("nth") <= per_language).orderBy("lang", "id", "text").select("lang", "text").collect()


def identify(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", held: int = 2, folds: int = 4, per_language: int = SAMPLE_PER_LANGUAGE) -> DataFrame:
    """One row per row of docs: doc_id, held_out, lang_pred, score, n_switches.

    `und` with score 0 where the text is null or has no letter, or nothing could be learned.
    score is the expected share of the text's words in lang_pred; n_switches counts neighbours
    whose likeliest labels differ. Repeated rows repeat; an empty table gives no rows.
    """
    rows = sample_labelled(docs, id_col, text, lang, held, folds, per_language)
    model = train([r.text for r in rows], [r.lang for r in rows]) if rows else None
    shared = docs.sparkSession.sparkContext.broadcast(model)  # SLOTS x languages single-precision numbers
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["doc_id", "held_out", "lang_pred", "score", "n_switches"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for t in slabs(batches, "text", 3_000_000):
            n = t.num_rows
            lang_pred, score, switches = np.array(["und"] * n, object), np.zeros(n), np.zeros(n, np.int64)
            has = t["has"].to_numpy().astype(bool)
            if m is not None:
                gamma, before, letter = label_words(m, t["text"].combine_chunks())
                doc = ragged(np.diff(before))[0]
                k = len(m.languages)
                total = np.stack([np.bincount(doc, gamma[:, j] * letter, minlength=n) for j in range(k)], 1)
                words = total.sum(1)
                ok = has & (words > 0)
                lang_pred[ok] = np.array(m.languages, object)[total[ok].argmax(1)]
                score[ok] = np.minimum(1.0, total[ok].max(1) / words[ok])
                best = gamma.argmax(1)
                change = (best[1:] != best[:-1]) & (doc[1:] == doc[:-1])
                switches = np.bincount(doc[1:][change], minlength=n)
            yield pa.RecordBatch.from_arrays([t["doc_id"].combine_chunks(), t["held_out"].combine_chunks(), pa.array(lang_pred, pa.string()), pa.array(score), pa.array(switches, pa.int64())], names)

    rows = docs.select(F.col(id_col).alias("doc_id"), (crc_mod(id_col, folds) == held).alias("held_out"), F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("has"), whole_text(docs, text).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double, n_switches long")


def query(spark, sf_dir):
    """op7: every whole document."""
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
