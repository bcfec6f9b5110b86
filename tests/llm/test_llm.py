"""The ten operators against brute force, the tokenizer libraries, or held-out accuracy."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from glossa.llm import ann, chain, exact_dedup, hmm_lm, jaccard_join, language_id, mixing, quality, sentencepiece_codec, suffix_dedup, token_count
from glossa.llm.common import rice_decode, rice_encode

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}
D = "/root/testdata/sf0.001"
ODD = [(1, None), (2, ""), (3, "x" * 70_000), (4, "a b c"), (5, "a b c"), (5, "a b c"), (6, "\n\t "), (None, "a b c"), (7, "é ü 日本 😀")]


def frame(spark, rows, extra=True):
    """Documents with columns whose names the operators use inside."""
    df = spark.createDataFrame(rows, "doc_id long, text string")
    if extra:
        df = df.selectExpr("*", "1 as size", "2 as fp", "3 as node", "'s' as source", "4 as target", "'en' as lang", "5 as key", "6 as uid")
        df = df.withColumn("n", F.lit(7))
    return df


def corpus(seed=1, n=60):
    """Texts with copies, near copies and shared passages."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(150)]
    make = lambda k: [rng.choice(words) for _ in range(k)]
    passage = make(40)
    out = []
    for _ in range(n):
        kind = rng.random()
        if out and kind < 0.2:
            out.append(out[rng.randrange(len(out))])
        elif out and kind < 0.5:
            w = out[rng.randrange(len(out))].split(" ")
            w[rng.randrange(len(w))] = "changed"
            out.append(" ".join(w))
        elif kind < 0.65:
            out.append(" ".join(make(30) + passage + make(30)))
        else:
            out.append(" ".join(make(rng.randint(1, 90))))
    return [(i * 3, t) for i, t in enumerate(out)]


# 1
def test_rice_round_trip():
    rng = np.random.default_rng(0)
    for k in (0, 3, 17):
        v = rng.integers(0, 1 << 18, 500).astype(np.uint64)
        assert (rice_decode(rice_encode(v, k)) == v).all()
    assert len(rice_decode(rice_encode(np.zeros(0, np.uint64), 4))) == 0


@pytest.mark.parametrize("rows", [ODD, corpus(), []])
def test_exact_dedup(spark, rows):
    got = exact_dedup.exact_dedup(frame(spark, rows)).collect()
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    want = collections.Counter()
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        for i in ids:
            want[(i, keep, len(ids), hashlib.sha256(t.encode()).hexdigest())] += 1
    assert collections.Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    kept = [r for r in got if r.kept]
    assert len(kept) == len(groups) and all(r.doc_id == r.keep_id for r in kept)
    assert exact_dedup.drop_copies(frame(spark, rows)).count() == len(groups)


def test_exact_dedup_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "BROADCAST_ROWS", 0)
    rows = corpus(3)
    assert sum(r.kept for r in exact_dedup.exact_dedup(frame(spark, rows)).collect()) == len({t for _, t in rows})


# 2
def brute_nearest(x, ids, q, k=10):
    d = np.sqrt(((x - x[q]) ** 2).sum(1))
    d[ids == ids[q]] = np.inf
    return ids[np.lexsort((ids, d))[:k]], np.sort(d)[:k]


def test_ann_recall_on_whole_tables(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    kept = [(r.vec_id, r.embedding) for r in ann.valid_vectors(rows, "vec_id", "embedding").select("vec_id", F.col("v").alias("embedding")).collect()]
    ids, x = np.array([i for i, _ in kept]), np.array([v for _, v in kept], float)
    assert ann.parts_for(len(ids)) > 1
    got = collections.defaultdict(set)
    for r in ann.search(rows).collect():
        got[r.query_id].add(r.vec_id)
    asked = np.flatnonzero(ids % 100 == 0)
    want = [set(brute_nearest(x, ids, q)[0].tolist()) for q in asked]
    assert sum(len(w & got[ids[q]]) for w, q in zip(want, asked)) >= 0.95 * sum(map(len, want))


def test_ann_recall_and_exact_scores(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((40, 16)) * 3
    x = (centres[rng.integers(0, 40, 4000)] + rng.standard_normal((4000, 16))).astype(np.float32)
    x[::3] = x[0]  # one vector that a third of all rows share
    ids = np.arange(4000)
    assert ann.parts_for(4000) == 16
    got = collections.defaultdict(list)
    for r in ann.search(spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<float>")).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    hit = 0
    for q in range(0, 4000, 100):
        want, dist = brute_nearest(x.astype(float), ids, q)
        assert len(got[q]) == 10
        hit += len({v for v, _ in got[q]} & set(want.tolist()))
        assert all(abs(s - math.sqrt(((x[v].astype(float) - x[q]) ** 2).sum())) < 1e-12 for v, s in got[q])
    assert hit / 400 >= 0.9


def test_ann_leaves_out_bad_vectors(spark):
    rows = [(0, [1.0, 0.0]), (100, [0.0, 1.0]), (1, None), (2, [0.0, 0.0]), (3, [float("nan"), 1.0]), (4, [None, 1.0]), (5, [1.0]), (6, [float("inf"), 1.0]), (7, [1.0, 0.0]), (7, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted((r.query_id, r["rank"], r.vec_id) for r in ann.search(df).collect())
    assert got == [(0, 1, 7), (0, 2, 100), (100, 1, 0), (100, 2, 7)]
    assert ann.search(df.limit(0)).count() == 0


def test_balanced_parts():
    x = np.random.default_rng(1).standard_normal((1000, 8))
    sizes = np.bincount(ann.balanced_parts(x, ann.neighbours(x, 5), 8))
    assert sizes.max() - sizes.min() <= 1


# 3 and 5
TEXTS = ["", " ", "  a ", "a  b   c      d" + " " * 37 + "x", "\n\n \t x", "é́ x　 \U0001f600", "<s> </s> <0x0A> ▁▁ a▁b", "a" * 3000, "\x00\x01x", "don't we'll I'M 12a", "a<|endoftext|>b  \n\n x", "<|endoftext|><|endoftext|>"]


def random_texts(n=300):
    rng = random.Random(1)
    letters = "abcdefghijklmnopqrstuvwxyz    ABCEéèßü0123456789.,!?'-\n"
    return ["".join(rng.choice(letters) for _ in range(rng.randint(1, 200))) for _ in range(n)]


def test_pieces_are_the_librarys(spark):
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library, codec = sentencepiece.SentencePieceProcessor(model_file=path), sentencepiece_codec.Codec(path)
    texts = TEXTS + random_texts()
    assert [codec.encode(t) for t in texts] == library.encode(texts)
    ids = library.encode(texts)
    assert [codec.decode(i) for i in ids] == [library.decode(i) for i in ids]
    rows = [(i, t) for i, t in enumerate(texts)] + [(-1, None), (-1, None)]
    got = sentencepiece_codec.encode_documents(frame(spark, rows), path).collect()
    # a text that holds the space mark itself comes back with spaces, as the library has it
    assert len(got) == len(rows) and all(r.round_trip == ("▁" not in (dict(rows)[r.doc_id] or "")) for r in got) and [r.n_pieces for r in got if r.doc_id == -1] == [0, 0]


def unigram_model(pieces, byte_fallback=False):
    """A model file by hand: pieces with scores, the identity normaliser, no training."""
    import struct

    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    def part(number, raw):
        return varint(number << 3 | 2) + varint(len(raw)) + raw

    out = b""
    special = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{b:02X}>", 0.0, 6) for b in range(256 if byte_fallback else 0)]
    for p, s, t in special + [(p, s, 1) for p, s in pieces]:
        out += part(1, part(1, p.encode()) + varint(2 << 3 | 5) + struct.pack("<f", s) + varint(3 << 3) + varint(t))
    out += part(2, varint(3 << 3) + varint(1) + varint(35 << 3) + varint(int(byte_fallback)))
    return out + part(3, part(1, b"identity") + varint(3 << 3) + varint(1) + varint(4 << 3) + varint(1))


@pytest.mark.parametrize("byte_fallback", [False, True])
def test_unigram_pieces_are_the_librarys(tmp_path, byte_fallback):
    import sentencepiece

    rng = random.Random(6)
    pieces = {c: -rng.randint(40, 60) / 8 for c in "abde" + sentencepiece_codec.SPACE}  # eighths: sums are exact in any precision; no c
    while len(pieces) < 120:
        pieces.setdefault(("" if rng.random() < 0.6 else sentencepiece_codec.SPACE) + "".join(rng.choice("abcde") for _ in range(rng.randint(1, 5))), -rng.randint(20, 90) / 8)
    del pieces["c"]
    path = str(tmp_path / "unigram.model")
    with open(path, "wb") as f:
        f.write(unigram_model(pieces.items(), byte_fallback))
    library, codec = sentencepiece.SentencePieceProcessor(model_file=path), sentencepiece_codec.Codec(path)
    assert not codec.bpe
    texts = ["".join(rng.choice("abcde  xé") for _ in range(rng.randint(0, 60))) for _ in range(400)] + ["", " ", "ccc", "xxé", "abcde" * 200]
    assert [codec.encode(t) for t in texts] == library.encode(texts)


def test_token_counts_are_the_librarys(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    texts = TEXTS + random_texts()
    want = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    got = token_count.token_counts(frame(spark, [(i, t) for i, t in enumerate(texts)] + [(-1, None)]), path)
    by = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in got.collect()}
    assert [by[i][1] for i in range(len(texts))] == want and by[-1] == (0, 0, False)
    assert all(by[i][0] == len(t.encode()) and by[i][2] == (by[i][1] > 512) for i, t in enumerate(texts))


def test_codecs_take_long_texts_and_empty_tables(spark):
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    rng = random.Random(4)
    long = [" ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9))) for _ in range(60_000)), "z" * 30_000, "<|endoftext|> " * 5000]
    pieces, tokens = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")
    docs = frame(spark, list(enumerate(long))).withColumn("n_pieces", F.lit("x")).withColumn("n_tokens", F.lit(1))
    library, other = sentencepiece.SentencePieceProcessor(model_file=pieces), Tokenizer.from_file(tokens)
    assert {r.doc_id: list(r.ids) for r in sentencepiece_codec.encode_documents(docs, pieces).collect()} == dict(enumerate(library.encode(long)))
    assert {r.doc_id: r.n_tokens for r in token_count.token_counts(docs, tokens).collect()} == {i: len(other.encode(t, add_special_tokens=False).ids) for i, t in enumerate(long)}
    for got in (sentencepiece_codec.encode_documents(docs.limit(0), pieces), sentencepiece_codec.with_pieces(docs.limit(0), pieces), token_count.token_counts(docs.limit(0), tokens)):
        assert got.count() == 0


# 4
def test_quality_matches_a_direct_solve(spark):
    docs, labels = spark.read.parquet(f"{D}/documents.parquet"), spark.read.parquet(f"{D}/labels.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    label = {r.doc_id: float(r.quality) for r in labels.collect()}
    x = {i: v for (i, _), v in zip(rows, quality.statistics(pa.array([t for _, t in rows])))}
    fold = {i: zlib.crc32(str(i).encode()) % 5 for i, _ in rows}
    use = [i for i in x if i in label and fold[i] != 0]
    a, y = np.array([x[i] for i in use]), np.array([label[i] for i in use])
    scale = a.std(0)
    scale[scale <= 1e-9] = 1.0
    p = quality._fourier((a - a.mean(0)) / scale)
    first = np.array([fold[i] != 1 for i in use])
    d = p.shape[1]
    beta = np.linalg.solve(p[first].T @ p[first] + 1e-3 * len(use) / d * np.eye(d), p[first].T @ y[first])
    raw = {i: float(quality._fourier(((v - a.mean(0)) / scale)[None]) @ beta) for i, v in x.items()}
    # the monotone fit of the labels of the calibrating fold, by pooling neighbours in order
    at = sorted((raw[i], label[i]) for i in use if fold[i] == 1)
    pools: list[list[float]] = []
    for r, v in at:
        pools.append([r, v, 1])
        while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
            b = pools.pop()
            pools[-1] = [pools[-1][0] + b[0], pools[-1][1] + b[1], pools[-1][2] + b[2]]
    knots, values = np.array([q[0] / q[2] for q in pools]), np.array([q[1] / q[2] for q in pools])
    got = {r.doc_id: r.score for r in quality.classify(docs, labels).collect()}
    off = [abs(got[i] - np.interp(raw[i], knots, values)) for i in got]
    assert np.quantile(off, 0.95) < 0.02  # the histogram of the calibration rounds raw scores to 1/2048


def test_isotonic_is_the_monotone_fit():
    at, n, s = np.arange(5.0), np.array([1, 2, 0, 1, 2.0]), np.array([1, 0, 0, 1, 1.0])
    knots, values = quality.isotonic(at, n, s)
    assert (np.diff(values) >= 0).all() and abs(values[0] - 1 / 3) < 1e-12


def test_quality_on_held_out_rows(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = {r.doc_id: r for r in quality.classify(docs, labels).collect()}
    held = [(got[r.doc_id], r.quality) for r in labels.collect() if got[r.doc_id].held_out]
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    assert np.mean([r.predicted == q for r, q in held]) > 0.93 and all(0 <= r.score <= 1 for r in got.values())


def test_quality_odd_rows(spark):
    labels = spark.createDataFrame([(4, 1), (5, None), (1, 0), (2, 1)], "doc_id long, quality int")
    got = quality.classify(frame(spark, ODD), labels).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert quality.classify(frame(spark, []), labels).count() == 0
    assert {r.score for r in quality.classify(frame(spark, ODD), labels.limit(0)).collect()} == {0.5}


# 6
def brute_repeats(rows, length):
    seen = collections.Counter(b[k : k + length] for _, b in rows for k in range(len(b) - length + 1))
    out = collections.Counter()
    for i, b in rows:
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k : k + length] = b"\x01" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        runs = sum(1 for z in range(len(b)) if gone[z] and (not z or not gone[z - 1]))
        out[(i, len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest())] += 1
    return out


@pytest.mark.parametrize("hot, windows", [(1500, 150_000), (1, 150_000), (1, 7)])
def test_repeats_match_brute_force(spark, monkeypatch, hot, windows):
    monkeypatch.setattr(suffix_dedup, "HOT_WINDOWS", windows)
    rng = random.Random(3)
    rows = [(i, "".join(rng.choice("ab") for _ in range(rng.randint(0, 60)))) for i in range(40)] + [(100, "x" * 200), (101, None), (102, ""), (None, "éàü" * 20), (100, "x" * 200)]
    got = suffix_dedup.remove_repeats(frame(spark, rows), length=20, gram=8, hot=hot, keep_bytes=True).collect()
    assert collections.Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute_repeats([(i, (t or "").encode()) for i, t in rows], 20)
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in got)


def test_repeats_at_production_length(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    want = brute_repeats([(r.doc_id, r.text.encode()) for r in docs.collect()], 400)
    assert collections.Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(docs).collect()) == want
    assert suffix_dedup.remove_repeats(docs.limit(0)).count() == 0


def test_suffix_array():
    rng = random.Random(5)
    for trial in range(30):
        t = np.array([rng.choice([1, 2, 3, 3, 3] if trial % 2 else range(1, 255)) for _ in range(rng.randint(1, 200))] + [0], np.uint8)
        assert suffix_dedup.suffix_array(t, 1000).tolist() == sorted(range(len(t)), key=lambda i: t[i:].tobytes())


@pytest.mark.parametrize("most", [1, 1_000_000])
def test_neighbours_compare_each_byte_of_a_passage_once(monkeypatch, most):
    rng = np.random.default_rng(2)
    passage, compared, real = rng.integers(1, 200, 900).astype(np.uint8), [], suffix_dedup.ragged
    other = passage.copy()
    other[450] ^= 1
    text = np.concatenate([passage, [255], passage, [255], other, [255], [0]]).astype(np.uint8)
    at = np.arange(len(text))
    left = np.where(at < 2703, 900 - at % 901, 0)
    sa = suffix_dedup.suffix_array(text, 1000)
    want = [bool(left[i] >= 400 and left[j] >= 400 and (text[i : i + 400] == text[j : j + 400]).all()) for i, j in zip(sa, sa[1:])] + [False]
    monkeypatch.setattr(suffix_dedup, "COMPARED", most, raising=False)
    monkeypatch.setattr(suffix_dedup, "ragged", lambda n: compared.append(int(n.sum())) or real(n))
    assert suffix_dedup.equal_neighbours(text, sa, 400, left).tolist() == want and sum(want) > 500
    assert 0 < sum(compared) < 6 * 900 + 1503


# 7 and 9
def brute_chain(e, before, t, s):
    """(posteriors, transition expectations, expected starts, log-likelihoods) by the definition."""
    k = e.shape[1]
    gamma, pairs, starts, lik = np.zeros_like(e), np.zeros((k, k)), np.zeros(k), np.zeros(len(before) - 1)
    for d, (a, b) in enumerate(zip(before, before[1:])):
        if a == b:
            continue
        f, g = [s * e[a]], [np.ones(k)]
        for i in range(a + 1, b):
            lik[d] += np.log(f[-1].sum())
            f.append((f[-1] / f[-1].sum() @ t) * e[i])
        lik[d] += np.log(f[-1].sum())
        for i in range(b - 1, a, -1):
            x = t @ (e[i] * g[-1])
            g.append(x / x.sum())
        g.reverse()
        for i in range(b - a):
            gamma[a + i] = f[i] * g[i] / (f[i] @ g[i])
            if i:
                both = np.outer(f[i - 1], e[a + i] * g[i]) * t
                pairs += both / both.sum()
        starts += gamma[a]
    return gamma, pairs, starts, lik


@pytest.mark.parametrize("length, most", [(4, 1000), (512, 1000), (4, 10), (512, 7)])
def test_forward_backward_matches_the_definition(monkeypatch, length, most):
    rng = np.random.default_rng(0)
    monkeypatch.setattr(chain, "L", length)
    monkeypatch.setattr(chain, "MOST", most)
    before = np.concatenate([[0], np.cumsum([0, 5, 1, 0, 13, 29, 3])])
    emit, t, s = rng.random((9, 3)) + 0.01, rng.random((3, 3)) + 0.05, rng.random(3)
    t, s = t / t.sum(1, keepdims=True), s / s.sum()
    cls = rng.integers(0, 9, before[-1])
    gamma, pairs, starts, lik = brute_chain(emit[cls], before, t, s)
    for got, want in zip(chain.posteriors(emit[cls], before, t, s), (gamma, pairs, lik)):
        assert np.allclose(got, want)
    emitted = np.zeros_like(emit)
    np.add.at(emitted, cls, gamma)
    for got, want in zip(chain.expected_counts(emit, cls, before, t, s), (starts, pairs, emitted, lik.sum())):
        assert np.allclose(got, want)
    for got, want in zip(chain.expected_counts(emit.astype(np.float32), cls, before, t, s), (starts, pairs, emitted, lik.sum())):
        assert np.allclose(got, want, atol=1e-4)
    assert np.allclose(chain.log_likelihoods(emit, cls, before, t, s), lik)


@pytest.mark.parametrize("length, most", [(8, 1000), (8, 25)])
def test_forward_backward_of_rare_words_in_single_precision(monkeypatch, length, most):
    rng = np.random.default_rng(1)
    monkeypatch.setattr(chain, "L", length)
    monkeypatch.setattr(chain, "MOST", most)
    before = np.array([0, 60, 67])
    emit, t, s = (rng.random((9, 3)) + 0.01) * 1e-11, rng.random((3, 3)) + 0.05, np.full(3, 1 / 3)
    t /= t.sum(1, keepdims=True)
    cls = rng.integers(0, 9, before[-1])
    gamma, pairs, starts, lik = brute_chain(emit[cls], before, t, s)
    emitted = np.zeros_like(emit)
    np.add.at(emitted, cls, gamma)
    for got, want in zip(chain.expected_counts(emit.astype(np.float32), cls, before, t, s), (starts, pairs, emitted, lik.sum())):
        assert np.allclose(got, want, rtol=1e-5, atol=1e-4)
    assert np.allclose(chain.log_likelihoods(emit.astype(np.float32), cls, before, t, s), lik, rtol=1e-5)


def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r for r in language_id.identify(docs).collect()}
    lang = {r.doc_id: r.lang for r in docs.collect()}
    assert np.mean([r.lang_pred == lang[i] for i, r in got.items() if r.held_out]) > 0.97
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1 for i, r in got.items())


def test_languages_match_a_direct_computation(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    sample = language_id.sample_labelled(docs, "doc_id", "text", "lang", 2, 4, language_id.SAMPLE_PER_LANGUAGE)
    model = language_id.train([r.text for r in sample], [r.lang for r in sample])
    k = len(model.languages)
    got = {r.doc_id: r for r in language_id.identify(docs).collect()}
    for r in docs.limit(60).collect():
        words = [w.encode() for w in WORDS.findall(r.text.translate(LOWER))]
        data = np.frombuffer(b" ".join(words), np.uint8)
        end = np.cumsum([len(w) + 1 for w in words]) - 1
        e = np.array([model.emissions(*language_id.word_features(data, np.array([b - len(w)]), np.array([b])))[0] for w, b in zip(words, end)])
        gamma = brute_chain(e, np.array([0, len(words)]), model.transitions, np.full(k, 1 / k))[0]
        letter = [bool(re.search(rb"[A-Za-z\x80-\xff]", w)) for w in words]
        share = gamma[letter].sum(0) / sum(letter)
        assert got[r.doc_id].lang_pred == model.languages[share.argmax()] and abs(got[r.doc_id].score - share.max()) < 1e-6


def test_language_inside_a_text():
    model = language_id.train(["the cat and the dog and the bird"] * 20 + ["der hund und die katze und das haus"] * 20, ["en"] * 20 + ["de"] * 20)
    gamma, before, letter = language_id.label_words(model, pa.array(["the dog and the cat und die katze und das haus 12"]))
    best = [model.languages[k] for k in gamma.argmax(1)]
    assert best[:4] == ["en"] * 4 and best[6:11] == ["de"] * 5 and not letter[-1]


@pytest.mark.parametrize("number", [None, 40])
def test_language_of_null_and_shared_ids(spark, number):
    say = {"en": "the cat and the dog see the bird number", "de": "der hund und die katze sehen das haus nummer"}
    rows = [(number, f"{say[g]} {k // 2}", g) for k in range(2100) for g in say] + [(number, say["en"], "en")] * 3000
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    sample = language_id.sample_labelled(docs, "doc_id", "text", "lang", 2, 4, 250)
    assert collections.Counter(r.lang for r in sample) == {"en": 250, "de": 250}
    assert sorted(map(tuple, sample)) == sorted(map(tuple, language_id.sample_labelled(docs.repartition(7), "doc_id", "text", "lang", 2, 4, 250)))
    got = language_id.identify(docs).groupBy("lang_pred").count().collect()
    assert {r.lang_pred: r["count"] for r in got} == {"en": 5100, "de": 2100}


def test_language_odd_rows(spark):
    got = collections.Counter((r.doc_id, r.lang_pred) for r in language_id.identify(frame(spark, ODD)).collect())
    assert got[(1, "und")] == got[(2, "und")] == got[(6, "und")] == 1 and sum(got.values()) == len(ODD)
    assert language_id.identify(frame(spark, [])).count() == 0


@pytest.mark.parametrize("rows", [corpus(7), ODD])
def test_language_model_counts(spark, rows):
    got = hmm_lm.score_documents(frame(spark, rows)).collect()
    tokens = [(i, WORDS.findall((t or "").translate(LOWER)) + [None]) for i, t in rows]
    count = collections.Counter()
    for i, w in tokens:
        if zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2:
            count.update(w)
    n, v = sum(count.values()), len(count)
    want = collections.Counter((i, len(w), sum(count[x] > 0 for x in w), n, round(sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w), 6)) for i, w in tokens)
    assert collections.Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(np.isfinite(r.score) and r.score <= 0 for r in got)


def test_language_model_beats_its_base(spark):
    got = [r for r in hmm_lm.score_documents(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect() if r.held_out]
    assert sum(r.score for r in got) > sum(r.base_score for r in got)
    assert hmm_lm.score_documents(frame(spark, [])).count() == 0


def test_language_model_is_baum_welch_over_all_documents(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    blocks, _, counted, prior = hmm_lm.corpus_counts(docs, "doc_id", "text", 2, 7)
    m, history = hmm_lm.train(blocks, counted, prior)
    texts = [hmm_lm._positions(counted, r.asDict(), ~hmm_lm.unpack(r.held)) for r in blocks.collect()]

    def step(m):  # by the definition, in double precision
        sums, n = [0, 0, 0, 0], 0
        for cls, before, _, _ in texts:
            gamma, pairs, starts, lik = brute_chain(m.emit[cls], before, m.trans, m.start)
            emitted = np.zeros_like(m.emit)
            np.add.at(emitted, cls, gamma)
            sums, n = [x + y for x, y in zip(sums, (starts, pairs, emitted, lik.sum()))], n + len(cls)
        return sums[:3], sums[3] / n

    class Shared:
        value = counted

    got = hmm_lm._round(blocks.select("doc_ids", "held", "n", "ids", "vocab", "shape"), Shared, m, 1.0)
    want, fit = step(m)
    assert np.allclose(got[:-2], np.concatenate([x.ravel() for x in want]), rtol=1e-2, atol=1e-2) and abs(got[-2] / got[-1] - fit) < 1e-4
    full = [f for share, f in history if share == 1.0]
    assert len(full) > 1 and fit >= full[-1] - 1e-4 and full[-1] - full[-2] < hmm_lm.SETTLED[1]
    assert all(b > a - 1e-4 for a, b in zip(full, full[1:]))  # no round lowers the likelihood


def test_language_model_scores_are_the_forward_recursion(spark):
    rows = corpus(8, 40)
    docs = frame(spark, rows)
    blocks, owned, counted, prior = hmm_lm.corpus_counts(docs, "doc_id", "text", 2, 7)
    m, _ = hmm_lm.train(blocks, counted, prior)
    got = {r.doc_id: r.score for r in hmm_lm.score_documents(docs).collect()}
    count = collections.Counter()
    tokens = {i: WORDS.findall(t.translate(LOWER)) for i, t in rows}
    for i, w in tokens.items():
        if zlib.crc32(str(i).encode()) % 7 != 2:
            count.update(w)
    for r in blocks.collect():
        cls, before, at, _ = hmm_lm._positions(counted, r.asDict())
        lik = brute_chain(m.emit[cls], before, m.trans, m.start)[3] / math.log(10)
        for d, i in enumerate(r.doc_ids):
            share = 0.0
            for w, c in zip(tokens[i], cls[before[d] : before[d + 1] - 1]):
                if c > hmm_lm.OWN:
                    s = c - hmm_lm.OWN - 1
                    share += math.log10((count[w] + 1) / (counted.class_tokens[s] + counted.class_words[s] + 1))
            assert abs(got[i] - lik[d] - share) < 1e-6


def test_word_numbers_beyond_three_bytes():
    ids = np.array([0, 5, (1 << 24) + 7])
    planes = np.ascontiguousarray(ids.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    assert hmm_lm._ids(planes.tobytes(), 3).tolist() == ids.tolist() and hmm_lm._ids(planes[:3].tobytes(), 3).tolist() == [0, 5, 7]


# 8
def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    cap, left, target, open_ = {s: 2 * sizes[s] for s in names}, 1.5 * sum(sizes.values()), {}, list(names)
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if level * weight[s] > cap[s]]
        if not over:
            return target | {s: level * weight[s] for s in open_}
        for s in over:
            target[s], left = float(cap[s]), left - cap[s]
        open_ = [s for s in open_ if s not in over]
    return target


@pytest.mark.parametrize("seed", range(6))
def test_mix(spark, seed):
    rng = random.Random(seed)
    rows = [(i, " ".join(["w"] * rng.choice([0, 1, 5, 40])), rng.choice(["a", "b", "c", "d", None, "é"][: rng.randint(1, 6)])) for i in range(300)] + [(900, None, "z"), (900, None, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df, block_rows=20, extra=("source",)).collect()
    sizes = collections.Counter()
    for _, t, s in rows:
        sizes[s] += len(WORDS.findall(t or ""))
    want = brute_targets(sizes)
    taken = collections.Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 and 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    assert len(got) == len(rows) and all(abs(taken[s] - want[s]) <= 1 for s in want)
    again = mixing.mix(df.repartition(5), block_rows=20).collect()
    assert sorted((r.doc_id, r.taken, r.position or -1) for r in got) == sorted((r.doc_id, r.taken, r.position or -1) for r in again)
    once = df.where("doc_id < 900")  # the rest repeat an id
    rows_of = collections.Counter(r.doc_id for r in mixing.curriculum(once).collect())
    assert all(rows_of[r.doc_id] == r.copies for r in mixing.mix(once).collect())


def test_curriculum_keeps_rows_of_null_and_repeated_ids(spark):
    rows = [((None, 7, i)[i % 3], " ".join([f"w{i}"] * (1 + i % 4)), "ab"[i % 2]) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.curriculum(df)
    assert got.columns == df.columns
    got = got.collect()
    want, copies = collections.Counter(), collections.Counter(r.text for r in got)
    for r in mixing.mix(df, extra=("source", "text")).collect():
        want[r.source] += r.taken
    assert {(r.doc_id, r.text, r.source) for r in got} <= set(rows) and max(copies.values()) <= 2
    for s, n in want.items():  # at most one document of a source is taken in part
        assert n <= sum(len(r.text.split()) for r in got if r.source == s) < n + 4
    assert any(r.doc_id is None for r in got)


def test_curriculum_of_odd_rows(spark):
    names = "size long, target double, position string, ordinal int, copies int, begin long, taken long, source_size long, row string"
    rows = [(i, None if i == 3 else "w " * ((i or 5) % 4), None if (i or 5) % 2 else "s", 1, 2.0, "p", 3, 4, 5, 6, 7, "r") for i in (1, 2, 2, 3, 4, 4, None, None, 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, " + names)
    got = mixing.curriculum(df)
    assert got.columns == df.columns
    counts = collections.Counter(tuple(r) for r in got.collect())
    assert set(counts) <= set(rows) and all(r[1] and r[1].strip() for r in counts)  # rows without words are not taken
    assert all(n <= 2 * rows.count(r) for r, n in counts.items())
    assert mixing.curriculum(df.limit(0)).count() == 0


def test_mix_of_nothing(spark):
    assert mixing.mix(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0


# 10
def brute_components(rows):
    sets = []
    for _, t in rows:
        w = WORDS.findall((t or "").translate(LOWER))
        sets.append({tuple(w)} if 0 < len(w) < 5 else {tuple(w[k : k + 5]) for k in range(len(w) - 4)})
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return collections.Counter((d, len(sets[i]), least.get(root(i)) if sets[i] else d) for i, (d, _) in enumerate(rows))


@pytest.mark.parametrize("rows", [corpus(1), corpus(2, 90), corpus(5, 90), ODD, []])
def test_components_match_brute_force(spark, rows):
    got = jaccard_join.jaccard_components(frame(spark, rows)).collect()
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(rows)


def test_components_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BROADCAST_ROWS", 0)
    rows = corpus(9)
    got = jaccard_join.jaccard_components(frame(spark, rows)).collect()
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(rows)


def test_sets_that_share_a_hash_are_told_apart(spark, monkeypatch):
    rows = corpus(1)
    monkeypatch.setattr(jaccard_join, "NODE_BITS", np.uint64(0x3FF << 5))  # the first seed puts two different sets on one id
    got = jaccard_join.jaccard_components(frame(spark, rows)).collect()
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(rows)
    monkeypatch.setattr(jaccard_join, "NODE_BITS", np.uint64(3))
    with pytest.raises(RuntimeError, match="told apart"):
        jaccard_join.jaccard_components(frame(spark, rows))


def test_components_of_long_texts(spark):
    rng = random.Random(8)
    words = [f"w{rng.randrange(5000)}" for _ in range(40_000)]
    near = words.copy()
    for k in range(0, 40_000, 80):  # a change in 80 words costs 5 of 80 shingles: still a link
        near[k] = "x"
    far = words.copy()
    for k in range(0, 40_000, 30):
        far[k] = "y"
    rows = [(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(far)), (4, " ".join(words).upper())]
    got = {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(frame(spark, rows)).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 1}


def test_near_copies_leave_the_smallest(spark):
    rows = corpus(4, 80)
    best = {d: c for d, _, c in brute_components(rows)}
    assert {r.doc_id for r in jaccard_join.keep_one(frame(spark, rows)).collect()} == {d for d, c in best.items() if d == c}


def shared_ids(seed):
    """Near copies among rows of repeated and null ids, on either side, and null ids as the only bridge."""
    rng = random.Random(seed)
    make = lambda: [f"w{rng.randrange(4000)}" for _ in range(60)]
    changed = lambda w, k: [*w[:k], "changed", *w[k + 1 :]]
    rows = []
    for k in range(12):
        w = make()
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(changed(w, 3)))]
        rows.append((2 * k + k % 2, " ".join(make())))  # the id again, with a text of its own
    for k in range(6):
        w = make()
        rows += [(100 + k, " ".join(w)), (None, " ".join(changed(w, 2))), (200 + k, " ".join(changed(changed(w, 2), 30)))]
    w = make()
    rows += [(None, " ".join(w)), (None, " ".join(changed(w, 30))), (7, "a b c d e f"), (7, "a b c d e f"), (None, "a b c d e f"), (None, None), (7, "")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("broadcast", [True, False])
def test_components_of_null_and_repeated_ids(spark, monkeypatch, broadcast):
    rows = shared_ids(3)
    if not broadcast:
        monkeypatch.setattr(jaccard_join, "BROADCAST_ROWS", 0)
    got = jaccard_join.jaccard_components(frame(spark, rows).repartition(3)).collect()
    want = brute_components(rows)
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == want
    assert want[(200, 56, 100)] == 1  # reached through a row without an id only
    left = sorted(r.text or "" for r in jaccard_join.keep_one(frame(spark, rows)).collect())
    groups = jaccard_join.jaccard_components(spark.createDataFrame([(i, t) for i, t in enumerate({t for _, t in rows if t})], "doc_id long, text string"))
    assert len({t for t in left if t}) == len([t for t in left if t]) - 1 == groups.select("component_id").distinct().count()  # the equal rows of id 7 stay together
    assert left.count("") == 2


def test_parities_never_lose_a_link():
    rng = random.Random(2)
    words = [str(i) for i in range(60)]
    texts = []
    for _ in range(40):
        w = words[:]
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(60)] = f"x{rng.randrange(1000)}"
        texts.append(" ".join(w[: rng.randint(50, 60)]))
    sets, before = jaccard_join.shingle_sets(pa.array(texts))
    told = jaccard_join.Parities(np.diff(before), jaccard_join._parities(sets, before), 80)
    each = [set(x.tolist()) for x in np.split(sets, before[1:-1])]
    i, j = np.triu_indices(40, 1)
    near = told.near(i, j)
    for a, b, ok in zip(i, j, near):
        both = len(each[a] & each[b])
        assert ok or 100 * both < 80 * (len(each[a]) + len(each[b]) - both)


def test_queries_match_their_sql(spark):
    import duckdb

    from glossa.llm import queries

    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{D}/documents.parquet'")
    plain = lambda rows, names: collections.Counter(tuple((n, round(v, 6) if isinstance(v, float) else v) for n, v in sorted(zip(names, r))) for r in rows)
    for name, sql in queries.ORACLES.items():
        got, want = queries.QUERIES[name](spark, D), con.sql(sql)
        assert plain(got.collect(), got.columns) == plain(want.fetchall(), want.columns), name


# the pipeline
def test_pipeline_stages_match_brute_force(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{D}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "exact dedup", "n-gram jaccard join", "mixing sources", "sentencepiece encoding"]
    good = stage["quality classifier"](spark, docs, D).cache()
    kept = {r.doc_id: r.text for r in good.collect()}
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{D}/labels.parquet").collect()}
    assert np.mean([i in kept for i, q in label.items() if q == 1]) > 0.97
    unique = stage["exact dedup"](spark, good, D).cache()
    last = {}
    for i, t in sorted(kept.items()):
        last[t] = i
    assert {r.doc_id for r in unique.collect()} == set(last.values()) and unique.columns == docs.columns
    apart = stage["n-gram jaccard join"](spark, unique, D).cache()
    best = brute_components([(r.doc_id, r.text) for r in unique.collect()])
    assert {r.doc_id for r in apart.collect()} == {d for d, _, c in best if d == c} and apart.columns == docs.columns
    mixed = stage["mixing sources"](spark, apart, D).cache()
    copies = {r.doc_id: r.copies for r in mixing.mix(apart).collect()}
    assert collections.Counter(r.doc_id for r in mixed.collect()) == collections.Counter({i: c for i, c in copies.items() if c}) and mixed.columns == docs.columns
    import public_tokenizers
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for r in stage["sentencepiece encoding"](spark, mixed, D).limit(50).collect():
        assert list(r.ids) == library.encode(r.text) and r.n_pieces == len(r.ids)
    assert corpus_pipeline.run(spark, D).count() == mixed.count()


def test_pipeline_stages_take_odd_rows(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rows = corpus(6, 40) + ODD + [(400, None), (401, "the end of a very long text " * 20_000), (None, None)]
    docs = frame(spark, rows).withColumn("__id", F.lit(1)).withColumn("ids", F.lit("x")).withColumn("score", F.lit(0.5))
    stage = dict(corpus_pipeline.STAGES)
    last = "sentencepiece encoding"
    for name in [n for n, _ in corpus_pipeline.STAGES if n != last]:
        assert stage[name](spark, docs.limit(0), D).count() == 0
        got = stage[name](spark, docs, D)
        assert got.columns == docs.columns
        found = collections.Counter((r.doc_id, r.text) for r in got.collect())
        assert set(found) <= set(rows)
        if name == "exact dedup":
            assert collections.Counter(t or "" for _, t in found.elements()) == collections.Counter({t or "" for _, t in rows})
        if name == "n-gram jaccard join":
            stay = {d for d, _, c in brute_components(rows) if d == c}
            assert {d for d, _ in found} == stay | {None}
        if name == "quality classifier":
            good = {(r.doc_id, r.predicted) for r in quality.classify(docs, spark.read.parquet(f"{D}/labels.parquet")).collect()}
            assert all((d, 1) in good for d, _ in found)
    out = stage[last](spark, docs, D)
    assert out.columns == [c for c in docs.columns if c != "ids"] + ["ids", "n_pieces"] and stage[last](spark, docs.limit(0), D).count() == 0
    assert collections.Counter((r.doc_id, r.text) for r in out.collect()) == collections.Counter(rows)
    assert all(r.n_pieces == len(r.ids) and (r.n_pieces == 0) == (not (r.text or "").strip(" ")) for r in out.collect())
