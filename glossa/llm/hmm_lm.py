"""Operator 9: language-model scoring with a hidden Markov model.

Latent states emit classes of words: each of the most frequent words and the end of a text is
its own class, all others share classes by their shape (first and last bytes, length). A word
is emitted with the probability of its class in the state times its smoothed share of the
class, so all counts of all training words enter the model, at any vocabulary size, while
Baum-Welch estimates a table of fixed size. The scaled forward recursion gives each text's
exact likelihood under the model.

Baum-Welch is distributed from its first round on: every round sums expected counts over the
blocks of all partitions, in slices of the model. Rounds begin with a share of the training
documents, which grows with the input, from states told apart by noise alone; when the
likelihood of that share settles, rounds over all training documents go on until it settles too.

Corpus counts go by blocks and owners: a task turns its rows into blocks of word numbers with
a sorted list of distinct word hashes, owners of hash ranges sum the blocks' counts and send
each block the corpus counts of its own words. No token row is ever shuffled, and a word that
a third of all tokens are costs one entry a block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.llm.chain import expected_counts, log_likelihoods
from glossa.llm.common import crc_mod, each_row, find_words, lower, mix, pack, ragged, slabs, slices, span_hash, summed, tasks_for, text_bytes, unpack, whole_text
from glossa.session import cut

STATES = 6
#: Words with a class of their own, and shape classes; both bound what is broadcast and summed.
OWN, SHAPES = 8191, 4096
#: The shares of the training documents that rounds run over, one after another, and by how much a round must raise
#: the mean logarithm of a position's probability to be followed by another of its share. The last share is all.
SHARES, SETTLED = (1 / 16, 1.0), (0.004, 0.001)
#: Only stops a model that never settles.
MOST_ROUNDS = 60
#: Bytes of text in a block, and entries that one owner may hold.
BLOCK_BYTES, OWNER_ENTRIES = 8_000_000, 20_000_000
CLASSES = OWN + 1 + SHAPES
#: Tasks that merge owners' lists of at most OWN words, and slices of the model in which expected counts are summed.
SUM_TASKS, SLICES = 16, 32


def _shapes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The shape class of each word."""
    length = np.minimum(end - start, 12).astype(np.uint64)
    a = data[start].astype(np.uint64) | data[np.minimum(start + 1, end - 1)].astype(np.uint64) << np.uint64(8)
    b = data[end - 1].astype(np.uint64) | data[np.maximum(end - 2, start)].astype(np.uint64) << np.uint64(8)
    return (mix(a | b << np.uint64(16) | length << np.uint64(32)) % np.uint64(SHAPES)).astype(np.uint16)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    base, k = TaskContext.get().partitionId() << 20, 0
    held: list[tuple] = []

    def flush() -> pa.RecordBatch:
        nonlocal k
        vocab, first = np.unique(np.concatenate([h[0] for h in held]), return_index=True)
        shape = np.concatenate([h[1] for h in held])[first]
        ids = np.concatenate([np.searchsorted(vocab, h[0])[h[2]] for h in held]) if len(vocab) else np.zeros(0, np.int64)
        n = np.concatenate([h[3] for h in held])
        held_out = np.concatenate([h[4] for h in held])
        count = np.bincount(ids, np.repeat(~held_out, n), minlength=len(vocab)).astype(np.uint32) if len(ids) else np.zeros(0, np.uint32)
        planes = np.ascontiguousarray(ids.astype("<u4").view(np.uint8).reshape(-1, 4)[:, : 3 if len(vocab) <= 1 << 24 else 4].T)
        row = [base + k, pa.array([x for h in held for x in h[5]], pa.int64()).to_pylist(), pack(held_out), pack(n.astype(np.int64)), planes.tobytes(), pack(vocab), pack(count), pack(shape)]
        held.clear()
        k += 1
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, [pa.int64(), pa.list_(pa.int64())] + [pa.binary()] * 6)], ["block", "doc_ids", "held", "n", "ids", "vocab", "count", "shape"])

    size = 0
    for t in slabs(batches, "text", 2_000_000):
        data, off = text_bytes(t["text"].combine_chunks())
        data = lower(data)
        start, end, before = find_words(data, off)
        h, first, inverse = np.unique(span_hash(data, start, end), return_index=True, return_inverse=True)
        held.append((h, _shapes(data, start[first], end[first]), inverse.astype(np.uint32), np.diff(before), t["held"].to_numpy().astype(bool), t["doc_id"].to_pylist()))
        size += len(data)
        if size >= BLOCK_BYTES:
            yield flush()
            size = 0
    if held:
        yield flush()


def _ids(raw: bytes, words: int) -> np.ndarray:
    """Numbers of words from their byte planes: three or, in a block of more than 2**24 distinct words, four."""
    if not words:
        return np.zeros(0, np.int64)
    planes = np.frombuffer(raw, np.uint8).reshape(-1, words)
    return sum((p.astype(np.int64) << 8 * k for k, p in enumerate(planes)), np.zeros(words, np.int64))


def _send(owners: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, vocab, count, shape in zip(*[batch.column(c).to_pylist() for c in ("block", "vocab", "count", "shape")]):
                vocab, count, shape = unpack(vocab), unpack(count), unpack(shape)
                cuts = np.searchsorted(_owner(vocab, owners), np.arange(owners + 1))
                full = np.flatnonzero(np.diff(cuts))
                cols = [[pack(x[cuts[o] : cuts[o + 1]]) for o in full] for x in (vocab, count, shape)]
                yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([block] * len(full), pa.int64()), *[pa.array(c, pa.binary()) for c in cols]], ["owner", "block", "vocab", "count", "shape"])

    return run


def _owner(h: np.ndarray, owners: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(owners) >> np.uint64(32)).astype(np.int64)


def _own(key, pdf: pd.DataFrame) -> pd.DataFrame:
    """Answers to the blocks (kind 0), this owner's words with most counts (1), and sums by shape class (2)."""
    lists = [unpack(x) for x in pdf["vocab"]]
    size = np.array([len(x) for x in lists])
    h, inverse = np.unique(np.concatenate(lists), return_inverse=True)
    total = np.bincount(inverse, np.concatenate([unpack(x) for x in pdf["count"]]), minlength=len(h)).astype(np.int64)
    shape = np.zeros(len(h), np.uint16)
    shape[inverse] = np.concatenate([unpack(x) for x in pdf["shape"]])
    answers = np.split(total[inverse], np.cumsum(size)[:-1])
    top = np.lexsort((h, -total))[:OWN]
    top = top[total[top] > 0]
    known = total > 0
    by_shape = np.concatenate([np.bincount(shape, total, minlength=SHAPES), np.bincount(shape[known], minlength=SHAPES)])
    rows = [(0, b, pack(a), None) for b, a in zip(pdf["block"], answers)]
    rows += [(1, None, pack(h[top]), pack(np.stack([total[top], shape[top]]).ravel())), (2, None, pack(by_shape), pack(np.array([known.sum()])))]
    out = pd.DataFrame(rows, columns=["kind", "block", "payload", "more"])
    out["owner"] = int(key[0])
    return out[["owner", "kind", "block", "payload", "more"]]


@dataclass(frozen=True)
class Corpus:
    """Totals, and the bounded part of the vocabulary that every task needs."""

    tokens: int
    words: int
    docs: int
    own: np.ndarray  # hashes of words with a class of their own, sorted
    class_tokens: np.ndarray  # of shape classes, without those words
    class_words: np.ndarray

    def classes(self, vocab: np.ndarray, shape: np.ndarray) -> np.ndarray:
        """Class of each word: own words first, then the end, then shapes."""
        at = np.minimum(np.searchsorted(self.own, vocab), max(len(self.own) - 1, 0))
        own = self.own[at] == vocab if len(self.own) else np.zeros(len(vocab), bool)
        return np.where(own, at, OWN + 1 + shape.astype(np.int64))


def _positions(corpus: Corpus, row: dict, chosen: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Classes of all positions of a block (each text's words, then its end), positions before
    each text, where the words stand, and the words' numbers; of the chosen texts, if given."""
    n = unpack(row["n"])
    ids = _ids(row["ids"], int(n.sum()))
    if chosen is not None:
        ids, n = ids[np.repeat(chosen, n)], n[chosen]
    before = np.concatenate([[0], np.cumsum(n + 1)])
    at = ragged(n)[0] + np.arange(len(ids))
    cls = np.full(before[-1], OWN, np.int64)
    cls[at] = corpus.classes(unpack(row["vocab"]), unpack(row["shape"]))[ids]
    return cls, before, at, ids


@dataclass(frozen=True)
class Hmm:
    start: np.ndarray
    trans: np.ndarray
    emit: np.ndarray  # (CLASSES, K)


def _m_step(start: np.ndarray, trans: np.ndarray, emit: np.ndarray, prior: np.ndarray, weight: float = 200.0) -> Hmm:
    emit = emit + weight * prior[:, None]
    return Hmm((start + 1) / (start + 1).sum(), (trans + 1) / (trans + 1).sum(1, keepdims=True), emit / emit.sum(0))


def _chosen(row: dict, share: float) -> np.ndarray:
    """The training texts of a block that a share takes in, by a hash of their ids."""
    use = ~unpack(row["held"])
    if share < 1:
        use &= mix(np.array([x or 0 for x in row["doc_ids"]], np.int64).view(np.uint64)) / 2.0**64 < share
    return use


def _round(blocks: DataFrame, shared, m: Hmm, share: float) -> np.ndarray:
    """Expected starts, transitions and emissions, the log-likelihood and the number of positions, one after another.

    Each task sums its blocks and sends the sum in SLICES slices; a slice is summed over all tasks
    at one place, so the driver gets the model's size once, at any number of tasks.
    """
    spark = blocks.sparkSession
    model = spark.sparkContext.broadcast(m)
    size = STATES + STATES * STATES + CLASSES * STATES + 2

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        emit = model.value.emit.astype(np.float32)
        for row in each_row(batches):
            use = _chosen(row, share)
            if use.any():
                cls, before, _, _ = _positions(shared.value, row, use)
                starts, trans, emitted, lik = expected_counts(emit, cls, before, model.value.trans, model.value.start)
                total += np.concatenate([starts, trans.ravel(), emitted.ravel(), [lik, len(cls)]])
        if total[-1]:
            yield slices(total, SLICES)

    out = summed(blocks.mapInArrow(count, "slice int, s binary"), SLICES)
    model.unpersist()
    return out if len(out) else np.zeros(size)


def train(blocks: DataFrame, corpus: Corpus, prior: np.ndarray) -> tuple[Hmm, list[tuple[float, float]]]:
    """The model, and of each Baum-Welch round its share and the mean logarithm of a position's probability before it."""
    shared = blocks.sparkSession.sparkContext.broadcast(corpus)
    use = blocks.select("doc_ids", "held", "n", "ids", "vocab", "shape")
    noise = np.random.default_rng(11).gamma(2.0, 0.5, (CLASSES, STATES)) * prior[:, None]
    # states stay long enough at first to tell texts, not neighbouring words, apart
    m = Hmm(np.full(STATES, 1 / STATES), np.full((STATES, STATES), 0.1 / STATES) + 0.9 * np.eye(STATES), noise / noise.sum(0))
    k, history = STATES, []
    for share, settled in zip(SHARES, SETTLED):
        last = -np.inf
        while corpus.docs and len(history) < MOST_ROUNDS:
            s = _round(use, shared, m, share)
            if not s[-1]:
                break
            m = _m_step(s[:k], s[k : k + k * k].reshape(k, k), s[k + k * k : -2].reshape(CLASSES, k), prior)
            fit = s[-2] / s[-1]
            history.append((share, fit))
            if fit - last < settled:
                break
            last = fit
    return m, history


def corpus_counts(docs: DataFrame, id_col: str, text: str, held: int, folds: int) -> tuple[DataFrame, DataFrame, Corpus, np.ndarray]:
    """Blocks of word numbers, owners' answers to them, and the totals."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (crc_mod(id_col, folds) == held).alias("held"), whole_text(docs, text).alias("text"))
    blocks = cut(rows.mapInArrow(_blocks, "block long, doc_ids array<long>, held binary, n binary, ids binary, vocab binary, count binary, shape binary"))
    n = blocks.agg(F.count("*").alias("n"), (F.sum(F.length("vocab")) / 8).cast("long").alias("v"), F.sum(F.size("doc_ids")).alias("d")).first()
    owners = int(max(tasks_for(docs.sparkSession), (n.v or 0) // OWNER_ENTRIES + 1))
    sent = blocks.select("block", "vocab", "count", "shape").mapInArrow(_send(owners), "owner int, block long, vocab binary, count binary, shape binary")
    owned = cut(sent.groupBy("owner").applyInPandas(_own, "owner int, kind int, block long, payload binary, more binary"))
    train_docs = rows.where("not held").count()
    hashes, counts, shapes = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    tokens, words, class_sums = train_docs, int(train_docs > 0), np.zeros(2 * SHAPES)
    # owners' lists are merged pairwise on the executors until few are left, each at most OWN long
    for r in _merged_tops(owned).collect():
        hashes.append(unpack(r.payload))
        c, s = unpack(r.more).reshape(2, -1)
        counts.append(c)
        shapes.append(s)
    for r in _merged_sums(owned).collect():
        class_sums += unpack(r.payload)
        words += int(unpack(r.more)[0])
    h, c, s = np.concatenate(hashes), np.concatenate(counts), np.concatenate(shapes)
    best = np.lexsort((h, -c))[:OWN]
    best = best[np.argsort(h[best])]
    tokens += int(class_sums[:SHAPES].sum())
    class_sums[:SHAPES] -= np.bincount(s[best], c[best], minlength=SHAPES)
    class_sums[SHAPES:] -= np.bincount(s[best], minlength=SHAPES)
    prior = np.zeros(CLASSES)
    prior[: len(best)] = c[best]
    prior[OWN] = train_docs
    prior[OWN + 1 :] = class_sums[:SHAPES] + 1
    return blocks, owned, Corpus(tokens, words, train_docs, h[best], class_sums[:SHAPES], class_sums[SHAPES:]), prior / prior.sum()


def _merged_tops(owned: DataFrame) -> DataFrame:
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, c = np.zeros(0, np.uint64), np.zeros((2, 0), np.int64)
        for r in each_row(batches):
            h, c = np.concatenate([h, unpack(r["payload"])]), np.hstack([c, unpack(r["more"]).reshape(2, -1)])
            best = np.lexsort((h, -c[0]))[:OWN]
            h, c = h[best], c[:, best]
        if len(h):
            yield pa.RecordBatch.from_arrays([pa.array([pack(h)], pa.binary()), pa.array([pack(c.ravel())], pa.binary())], ["payload", "more"])

    return owned.where("kind = 1").select("payload", "more").repartition(SUM_TASKS).mapInArrow(merge, "payload binary, more binary")


def _merged_sums(owned: DataFrame) -> DataFrame:
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, words = np.zeros(2 * SHAPES), 0
        for r in each_row(batches):
            total, words = total + unpack(r["payload"]), words + int(unpack(r["more"])[0])
        yield pa.RecordBatch.from_arrays([pa.array([pack(total)], pa.binary()), pa.array([pack(np.array([words]))], pa.binary())], ["payload", "more"])

    return owned.where("kind = 2").select("payload", "more").repartition(SUM_TASKS).mapInArrow(merge, "payload binary, more binary")


def score_documents(docs: DataFrame, id_col: str = "doc_id", text: str = "text", held: int = 2, folds: int = 7) -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Scores are log10 probabilities of the lower-cased (A-Z) words and the end of the text. Null
    text is empty: its one token is the end. With no training rows every score is 0. Repeated
    rows repeat and count each for itself; an empty table gives no rows.
    """
    blocks, owned, corpus, prior = corpus_counts(docs, id_col, text, held, folds)
    model, _ = train(blocks, corpus, prior)
    shared = docs.sparkSession.sparkContext.broadcast((corpus, model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        corpus, m = shared.value
        for row in each_row(batches):
            n = unpack(row["n"])
            answers = sorted(row["answers"] or [], key=lambda a: a["owner"])
            c = np.concatenate([unpack(a["payload"]) for a in answers]) if answers else np.zeros(0, np.int64)
            cls, before, at, ids = _positions(corpus, row)
            doc = ragged(n)[0]
            floor = np.log10(corpus.tokens + corpus.words + 1)
            base = np.bincount(doc, np.log10(c + 1.0)[ids], minlength=len(n)) - (n + 1) * floor + np.log10(corpus.docs + 1)
            known = np.bincount(doc, c[ids] > 0, minlength=len(n)).astype(np.int64) + int(corpus.docs > 0)
            if corpus.docs:
                lik = log_likelihoods(m.emit, cls, before, m.trans, m.start) / np.log(10)
                word_cls = corpus.classes(unpack(row["vocab"]), unpack(row["shape"]))
                shape = np.maximum(word_cls - OWN - 1, 0)
                share = np.where(word_cls > OWN, np.log10(c + 1.0) - np.log10(corpus.class_tokens[shape] + corpus.class_words[shape] + 1), 0.0)
                score = lik + np.bincount(doc, share[ids], minlength=len(n))
            else:
                score = base
            yield pa.RecordBatch.from_arrays(
                [pa.array(row["doc_ids"], pa.int64()), pa.array(unpack(row["held"])), pa.array(n + 1), pa.array(known), pa.array(np.full(len(n), corpus.tokens)), pa.array(base), pa.array(score)],
                ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    answers = owned.where("kind = 0").groupBy("block").agg(F.collect_list(F.struct("owner", "payload")).alias("answers"))
    home = blocks.select("block", "doc_ids", "held", "n", "ids", "vocab", "shape").join(answers, "block", "left").drop("block")
    return home.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def query(spark, sf_dir):
    """op9: every whole document."""
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
