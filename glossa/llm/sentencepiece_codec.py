"""Operator 3: SentencePiece encoding and decoding.

An Aho-Corasick automaton over the pieces drives one Viterbi pass over the text: at every
position the output links give all pieces that end there, and each relaxes the best state
of the position. For a unigram model the state is the best score. For a BPE model a score
sum does not give the model's own segmentation, so a piece may relax a position only if it
follows the piece before it the way the merges would have it: the pair, merged by itself,
must stay that pair. Exactly one piece at each position passes, and the path it leads back
along is the merges' result.

For a unigram model the best sum is taken in double precision; of equal sums the longest last
piece wins, and a character of no piece costs UNKNOWN below the least score.

Texts are cut where no piece can reach across (before a run of spaces that follows other
characters, and, for BPE, at characters of no piece). The chunks of a batch of texts that were
not met before advance together, a character a step: the automaton's transitions, its failure
and output links and the verdicts on pairs are arrays. What a worker remembers is bounded:
CHUNKS short chunks, dropped at the end of a task, and the verdicts on PAIRS pairs, which hold
for every text of the vocabulary; some 20 MB each.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.llm.common import ragged, resident, slabs, trim, whole_text

SPACE = "▁"
#: Chunks that a worker remembers, of at most SHORT characters each, and pairs of pieces.
CHUNKS, SHORT, PAIRS = 100_000, 96, 1_000_000
#: Lengths up to which chunks advance together, so that short ones do not pay for long ones.
STEPS = (12, 24, 48, SHORT)
#: How far below the least score of a unigram model an unknown character lies (a fixed value of the format).
UNKNOWN = 10.0
#: A state is a piece's number plus one, shifted by this, so that state + piece names a pair.
_SHIFT = 20
_NO_STATE = -(1 << 50)
_U = np.uint64


class Table:
    """A map from integers to small integers as two arrays, asked and filled many keys at a time; -1: not there."""

    def __init__(self, bits: int, dtype):
        self.shift, self.mask, self.n = _U(64 - bits), (1 << bits) - 1, 0
        self.keys, self.values = np.full(1 << bits, (1 << 64) - 1, _U), np.full(1 << bits, -1, dtype)

    def _at(self, keys: np.ndarray) -> np.ndarray:
        return (keys * _U(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        at = self._at(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.values[at], -1)
        left = np.flatnonzero((found != keys) & (found != _U((1 << 64) - 1)))
        while len(left):
            at[left] = (at[left] + 1) & self.mask
            found = self.keys[at[left]]
            hit = found == keys[left]
            out[left[hit]] = self.values[at[left[hit]]]
            left = left[~hit & (found != _U((1 << 64) - 1))]
        return out

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Distinct keys that are not there yet; the caller sees to it that half of the places stay free."""
        at, left = self._at(keys), np.arange(len(keys))
        self.n += len(keys)
        while len(left):
            free = left[self.keys[at[left]] == _U((1 << 64) - 1)]
            self.keys[at[free]] = keys[free]
            won = free[self.keys[at[free]] == keys[free]]
            self.values[at[won]] = values[won]
            left = left[self.keys[at[left]] != keys[left]]
            at[left] = (at[left] + 1) & self.mask


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The fields of a protocol-buffer message: number and value."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = raw[at]
            at += 1
            out |= (b & 127) << shift
            if b < 128:
                return out
            shift += 7

    while at < len(raw):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            n = {1: 8, 5: 4}.get(kind)
            n = varint() if n is None else n
            yield key >> 3, raw[at : at + n]
            at += n


class Codec:
    """A SentencePiece model (BPE or unigram) with the identity normaliser."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            raw = f.read()
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.types: list[int] = []
        self.bpe, self.prefix = False, True
        squeeze = True
        for number, value in _fields(raw):
            if number == 1:
                f = dict(_fields(value))
                self.pieces.append(f.get(1, b"").decode())
                self.scores.append(float(np.frombuffer(f[2], "<f4")[0]) if 2 in f else 0.0)
                self.types.append(f.get(3, 1))
            elif number == 2:
                self.bpe = dict(_fields(value)).get(3, 1) == 2
            elif number == 3:
                f = dict(_fields(value))
                if f.get(2):
                    raise ValueError("only the identity normaliser is supported")
                self.prefix, squeeze = bool(f.get(3, 1)), bool(f.get(4, 1))
        self.squeeze = squeeze
        if any(t == 4 for t in self.types):
            raise ValueError("user-defined symbols are not supported")
        self.unk = self.types.index(2)
        self.byte = {int(p[3:5], 16): i for i, (p, t) in enumerate(zip(self.pieces, self.types)) if t == 6}
        self.id = {p: i for i, (p, t) in enumerate(zip(self.pieces, self.types)) if t == 1}
        self.auto = ahocorasick.Automaton()
        for p, i in self.id.items():
            self.auto.add_word(p, (i, len(p)))
        self.auto.make_automaton()
        self.single = {p for p in self.id if len(p) == 1}
        inside = any(SPACE in p.lstrip(SPACE) for p in self.id)
        cut = "".join(c for c in "\n\t\r" if not any(c in p for p in self.id))
        self.chunks = re.compile("[\\s\\S]+" if inside else f"{SPACE}+[^{SPACE}{cut}]*|[^{SPACE}{cut}]+" + (f"|[{cut}]" if cut else "")).findall
        self.length = np.array([len(p) for p in self.pieces], np.int64)
        self.pairs: dict[int, bool] = {}  # may a piece follow a state: as asked one by one
        self.told = Table(21, np.int8)  # and many at a time
        if self.bpe:
            self._arrays()
        self.forget()
        self.least = min((self.scores[i] for i in self.id.values()), default=0.0)
        self.shown = [self._show(i) for i in range(len(self.pieces))]

    def _arrays(self) -> None:
        """The automaton as arrays: transitions, failure links, the piece that ends in a state, and output links."""
        goto: list[dict[str, int]] = [{}]
        ends = [-1]
        for p, i in self.id.items():
            at = 0
            for c in p:
                if c not in goto[at]:
                    goto[at][c] = len(goto)
                    goto.append({})
                    ends.append(-1)
                at = goto[at][c]
            ends[at] = i
        fail, link = [0] * len(goto), [0] * len(goto)
        line = list(goto[0].values())
        for at in line:  # breadth first: links lead to shorter strings
            link[at] = fail[at] if ends[fail[at]] >= 0 else link[fail[at]]
            for c, to in goto[at].items():
                f = fail[at]
                while f and c not in goto[f]:
                    f = fail[f]
                fail[to] = goto[f].get(c, 0)
                line.append(to)
        keys = np.array([at << 21 | ord(c) for at, row in enumerate(goto) for c in row], _U)
        self.goto = Table(max(1, (2 * len(keys)).bit_length()), np.int32)
        self.goto.put(keys, np.array([to for row in goto for to in row.values()], np.int32))
        self.fail, self.link, self.ends = np.array(fail), np.array(link), np.array(ends)

    def _show(self, i: int) -> str | None:
        """What a piece decodes to; None if its bytes need their neighbours."""
        if self.types[i] == 6:
            b = int(self.pieces[i][3:5], 16)
            return chr(b) if b < 128 else None
        return {1: self.pieces[i].replace(SPACE, " "), 2: " ⁇ "}.get(self.types[i], "")

    def _merged(self, s: str) -> list[str]:
        """s merged by itself: the best-scored pair of neighbours first, leftmost among equals."""
        parts = list(s)
        while len(parts) > 1:
            best, where = None, -1
            for k in range(len(parts) - 1):
                i = self.id.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or self.scores[i] > best):
                    best, where = self.scores[i], k
            if where < 0:
                break
            parts[where : where + 2] = [parts[where] + parts[where + 1]]
        return parts

    def _follows(self, a: int, b: int) -> bool:
        """Whether piece b may stand after piece a (a = -1: at the start)."""
        want = [self.pieces[b]] if a < 0 else [self.pieces[a], self.pieces[b]]
        return self._merged("".join(want)) == want

    def _segment(self, s: str) -> list[int]:
        """The pieces of a string all of whose characters are pieces, the way the merges have it."""
        n = len(s)
        last, start = [_NO_STATE] * (n + 1), [0] * (n + 1)
        last[0], done, known = 0, -1, self.pairs
        for end, (i, length) in self.auto.iter(s):
            if end != done:  # the longest piece first; the rest are passed over once one fits
                pair = last[end + 1 - length] + i
                ok = known.get(pair)
                if ok is None:
                    if pair < 0:
                        continue
                    if len(known) >= PAIRS:
                        known.clear()
                    ok = known[pair] = self._follows((pair >> _SHIFT) - 1, i)
                if ok:
                    last[end + 1], start[end + 1], done = i + 1 << _SHIFT, end + 1 - length, end
        out = []
        while n:
            out.append((last[n] >> _SHIFT) - 1)
            n = start[n]
        return out[::-1]

    def _best(self, s: str) -> list[tuple[int, int, int]]:
        """(piece, from, to) of the segmentation of the best score sum; unknown characters stand alone."""
        n = len(s)
        ends: list[list[tuple[int, int]]] = [[] for _ in range(n + 1)]
        for end, found in self.auto.iter(s):
            ends[end + 1].append(found)
        best, last, start = [0.0] * (n + 1), [self.unk] * (n + 1), [0] * (n + 1)
        for end in range(1, n + 1):
            top = -float("inf")
            for i, length in ends[end]:
                score = best[end - length] + self.scores[i]
                if score > top:
                    top, last[end], start[end] = score, i, end - length
            if s[end - 1] not in self.single and best[end - 1] + self.least - UNKNOWN > top:
                top, last[end], start[end] = best[end - 1] + self.least - UNKNOWN, self.unk, end - 1
            best[end] = top
        out = []
        while n:
            out.append((last[n], start[n], n))
            n = start[n]
        return out[::-1]

    def _unknown(self, c: str) -> list[int]:
        return [self.byte[b] for b in c.encode("utf-8", "surrogatepass")] if self.byte else [self.unk]

    def _chunk(self, s: str) -> tuple[int, ...]:
        out: list[int] = []
        if not self.bpe:
            for i, a, b in self._best(s):
                out += self._unknown(s[a:b]) if i == self.unk else [i]
        elif self.single.issuperset(s):
            out = self._segment(s)
        else:
            run = 0
            for k, c in enumerate([*s, None]):
                if c is None or c not in self.single:
                    if k > run:
                        out += self._segment(s[run:k])
                    if c is not None:
                        out += self._unknown(c)
                    run = k + 1
        return tuple(out)

    def _may(self, pairs: np.ndarray) -> np.ndarray:
        """Whether each pair of a state and a piece may stand; verdicts are remembered."""
        out = self.told.get(pairs)
        new = np.unique(pairs[out < 0])
        if len(new):
            if self.told.n + len(new) > PAIRS:
                self.told = Table(21, np.int8)
            told = np.array([self._follows((x >> _SHIFT) - 1, x & (1 << _SHIFT) - 1) for x in new.tolist()], np.int8)
            self.told.put(new, told)
            out[out < 0] = told[np.searchsorted(new, pairs[out < 0])]
        return out > 0

    def _walk(self, codes: np.ndarray, at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pieces of all chunks one after another, and how many each has. Chunk i holds the characters codes[at[i]:]
        of number n[i], all of them pieces; the longest come first."""
        last, start = np.full((len(n), n[0] + 1), -1, np.int32), np.zeros((len(n), n[0] + 1), np.int32)
        last[:, 0] = 0  # a state: 0 at the start, else a piece's number plus one
        state = np.zeros(len(n), np.int64)
        for t in range(int(n[0])):
            live = int(np.searchsorted(-n, -t, side="left"))
            c, left = codes[at[:live] + t].astype(_U), np.arange(live)
            while len(left):  # a transition, or the same from the failure link
                to = self.goto.get(state[left].astype(_U) << _U(21) | c[left])
                state[left] = np.where(to >= 0, to, self.fail[state[left]])
                left = left[to < 0]
            out, left = np.where(self.ends[state[:live]] >= 0, state[:live], self.link[state[:live]]), np.arange(live)
            while len(left):  # pieces that end here, the longest first, until one may follow the state before it
                piece = self.ends[out[left]]
                begin = t + 1 - self.length[piece]
                before = last[left, begin]
                ok = before >= 0
                ok[ok] = self._may(before[ok].astype(_U) << _U(_SHIFT) | piece[ok].astype(_U))
                last[left[ok], t + 1], start[left[ok], t + 1] = piece[ok] + 1, begin[ok]
                left = left[~ok]
                out[left] = self.link[out[left]]
                left = left[out[left] > 0]
        end, rows, found = n.copy(), np.arange(len(n)), []
        while len(rows):
            found.append((rows, last[rows, end[rows]] - 1))
            end[rows] = start[rows, end[rows]]
            rows = rows[end[rows] > 0]
        count = np.bincount(np.concatenate([r for r, _ in found]), minlength=len(n))
        ids, first = np.empty(int(count.sum()), np.int32), np.cumsum(count) - count
        for k, (r, piece) in enumerate(found):
            ids[first[r] + count[r] - 1 - k] = piece
        return ids, count

    def _chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all chunks one after another, and how many each has."""
        n = np.fromiter(map(len, chunks), np.int64, len(chunks))
        at = np.cumsum(n) - n
        codes = np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), np.uint32)
        together = np.zeros(len(chunks), bool)
        if self.bpe and len(chunks):
            single = self.goto.get(codes.astype(_U))
            known = (single >= 0) & (self.ends[np.maximum(single, 0)] >= 0)
            together = np.logical_and.reduceat(known, at) & (n <= SHORT)
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # chunks, ids, counts
        low = 0
        for high in STEPS:
            mine = np.flatnonzero(together & (n > low) & (n <= high))
            low = high
            if len(mine):
                mine = mine[np.argsort(-n[mine], kind="stable")]
                parts.append((mine, *self._walk(codes, at[mine], n[mine])))
        alone = np.flatnonzero(~together)
        if len(alone):
            each = [self._chunk(chunks[i]) for i in alone.tolist()]
            parts.append((alone, np.fromiter(chain.from_iterable(each), np.int32), np.fromiter(map(len, each), np.int64, len(each))))
        count = np.zeros(len(chunks), np.int64)
        for mine, _, k in parts:
            count[mine] = k
        ids, first = np.empty(int(count.sum()), np.int32), np.cumsum(count) - count
        for mine, found, k in parts:
            row, place = ragged(k)
            ids[first[mine][row] + place] = found
        return ids, count

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all whole texts one after another, without begin or end, and how many come before each text."""
        chunks, many = [], []
        for text in texts:
            if self.squeeze:
                text = re.sub(" +", " ", text.strip(" "))
            mine = self.chunks((SPACE if self.prefix else "") + text.replace(" ", SPACE)) if text else []
            chunks += mine
            many.append(len(mine))
        new = list(set(chunks).difference(self.slot))
        if len(self.slot) + len(new) > CHUNKS and self.slot:
            self.forget()
            new = list(set(chunks))
        if new:
            ids, count = self._chunks(new)
            self.slot.update(zip(new, range(len(self.slot), len(self.slot) + len(new))))
            self.begin = np.concatenate([self.begin, len(self.store) + np.cumsum(count) - count])
            self.count = np.concatenate([self.count, count])
            self.store = np.concatenate([self.store, ids])
        at = np.fromiter(map(self.slot.__getitem__, chunks), np.int64, len(chunks))
        row, place = ragged(self.count[at])
        out = self.store[self.begin[at][row] + place]
        before = np.concatenate([[0], np.cumsum(self.count[at])])[np.concatenate([[0], np.cumsum(many)]).astype(np.int64)]
        if not self.byte and len(out):  # neighbouring unknown characters of a text are one piece
            first = np.zeros(len(out) + 1, bool)
            first[before] = True
            keep = (out != self.unk) | first[:-1] | np.concatenate([[True], out[:-1] != self.unk])
            out, before = out[keep], np.concatenate([[0], np.cumsum(keep)])[before]
        if any(len(c) > SHORT for c in new) or len(self.slot) > CHUNKS:
            self.forget()  # long chunks are not kept
        return out, before

    def encode(self, text: str) -> list[int]:
        """The ids of a whole text, without begin or end."""
        return self.encode_all([text])[0].tolist()

    def forget(self) -> None:
        """At the end of a task: the worker lives on, its chunks need not."""
        self.slot: dict[str, int] = {}
        self.begin, self.count, self.store = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def decode(self, ids) -> str:
        """The text of ids; bytes that are no UTF-8 become replacement characters."""
        shown = self.shown
        parts = [shown[i] for i in ids]
        if None in parts:
            held, out = bytearray(), []
            for i, p in zip(ids, parts):
                if self.types[i] == 6:
                    held.append(int(self.pieces[i][3:5], 16))
                    continue
                if held:
                    out.append(_utf8(held))
                    held = bytearray()
                out.append(p)
            parts = [*out, _utf8(held)]
        text = "".join(parts)
        return text[1:] if self.prefix and text.startswith(" ") else text


def _utf8(raw: bytes) -> str:
    """Decoded, each byte that belongs to no character replaced by itself."""
    return re.sub("[\udc80-\udcff]", "�", bytes(raw).decode("utf-8", "surrogateescape"))


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec(path)
    resident("codec", _codecs.clear)
    return _codecs[path]


def with_pieces(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """The rows of docs, all columns, with `ids` and `n_pieces` of the whole text (null: none), in small Arrow batches.

    Columns of those names are replaced. No shuffle; repeated rows repeat; an empty table gives none.
    """
    from pyspark.sql import types as T

    kept = [f for f in docs.schema.fields if f.name not in ("ids", "n_pieces")]
    schema = T.StructType([*kept, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_pieces", T.LongType())])
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for t in slabs(batches, text, 500_000, "codec"):
            flat, off = c.encode_all([s or "" for s in t[text].to_pylist()])
            cols = [t[n].combine_chunks() for n in names]
            yield pa.RecordBatch.from_arrays([*cols, pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(flat)), pa.array(np.diff(off), pa.int64())], [*names, "ids", "n_pieces"])
        c.forget()
        trim()

    return docs.mapInArrow(run, schema)


def decode_column(column, path: str):
    """A column of texts for a column of id arrays (null: empty)."""

    @F.arrow_udf("string")
    def decode(ids: pa.Array) -> pa.Array:
        c = codec(path)
        return pa.array([c.decode(x or []) for x in ids.to_pylist()], pa.string())

    return decode(column)


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_pieces, ids, and whether decoding gives the text back. No shuffle.

    Null text counts as empty and has no pieces; repeated rows give repeated rows.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), whole_text(docs, text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for t in slabs(batches, "text", 2_000_000, "codec"):
            texts = t["text"].to_pylist()
            flat, off = c.encode_all(texts)
            same = [c.decode(x.tolist()) == s for x, s in zip(np.split(flat, off[1:-1]), texts)]
            yield pa.RecordBatch.from_arrays(
                [t["doc_id"].combine_chunks(), pa.array(np.diff(off), pa.int64()), pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(flat)), pa.array(same, pa.bool_())],
                ["doc_id", "n_pieces", "ids", "round_trip"])
        c.forget()
        trim()

    return rows.mapInArrow(run, f"doc_id {kind}, n_pieces long, ids array<int>, round_trip boolean")


def query(spark, sf_dir, vocabulary: str = "piece_bpe_32k.model"):
    """op3: the ids of every whole document."""
    import public_tokenizers

    return encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path(vocabulary))
