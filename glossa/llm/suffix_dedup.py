"""Operator 6: removal of long repeated passages with a suffix array.

A byte goes if a window of `length` bytes that covers it starts anywhere else too. Windows are
brought together by content: winnowing picks in every window the smallest hash of its
GRAM-byte grams, so equal windows pick the same anchor at the same place. An anchor's context
(what any window that picks it may cover) goes to the anchor's owner, who sorts the suffixes
of all distinct contexts of its anchors and reads repeats off adjacent common prefixes:

* two-stage sorting: only suffixes smaller than their successor are sorted directly; every
  other suffix is its first byte before a suffix whose place is known, so scanning buckets in
  order induces the rest;
* adjacent suffixes whose common prefix reaches the window length mark their windows.

Whole equal contexts are told apart from different ones by a 64-bit hash and its count before
any bytes move, so a passage that a third of all documents hold costs one entry for each
block of rows. Of the distinct contexts of an anchor only those move that share a core with
another: if a window is repeated, the bytes around its anchor agree over one of CORES stretches
that leave out less than a window's CORES-th part.

A core that more than HOT distinct contexts share is not sorted in one piece: windows over it
are compared by hash, split over tasks by hash range, which is the exact way at any size: its
contexts are cut to windows before they move, so what moves and what a task holds grow with the
windows over the core alone.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.llm.common import each_row, mix, pack, ragged, trim, slabs, span_hash, tasks_for, text_bytes, unpack, whole_text
from glossa.session import cut

LENGTH = 400
GRAM = 96
#: Bytes of text in a block; anchors and context bytes that one owner should hold.
BLOCK_BYTES, OWNER_ANCHORS = 10_000_000, 200_000
#: Asks for contexts in a row, about 1 MB.
ASK_ROWS = 20_000
#: Ids of documents whose contexts are asked for (16 bytes each) are broadcast up to this many.
BROADCAST_ROWS = 2_000_000
#: Stretches around an anchor, one of which any two places of a repeated window share whole.
CORES = 4
#: Contexts of one core up to which they are sorted as one text; windows that one task compares beyond that; bytes sorted at a time.
HOT, HOT_WINDOWS, SORT_BYTES = 1500, 150_000, 700_000
#: Bytes of neighbours compared at a time.
COMPARED = 1_000_000
_U = np.uint64


def anchors(data: np.ndarray, off: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, position, row) of the anchors of all windows: the rightmost smallest gram of each."""
    n = len(data) - gram + 1
    if n <= 0:
        return np.zeros(0, _U), np.zeros(0, np.int64), np.zeros(0, np.int64)
    w = length - gram + 1  # grams in a window
    at = np.arange(n)
    h = span_hash(data, at, at + gram)
    row = ragged(np.diff(off))[0]
    inside = row[:n] == row[gram - 1 :]
    # the smallest of w neighbours, the rightmost of equals, by blocks: ranks carry the place
    key = (h >> _U(24)) << _U(24) | _U((1 << 24) - 1) - (at % (1 << 24)).astype(_U)
    key[~inside] = _U((1 << 64) - 1)
    m = n - w + 1
    if m <= 0:
        return np.zeros(0, _U), np.zeros(0, np.int64), np.zeros(0, np.int64)
    padded = np.full(-(-n // w) * w, (1 << 64) - 1, _U)
    padded[:n] = key
    blocks = padded.reshape(-1, w)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    low = np.minimum(right[:m], left[w - 1 : w - 1 + m])
    whole = row[:m] == row[length - 1 : length - 1 + m]
    low = low[whole]
    place = np.flatnonzero(whole)
    if not len(low):
        return np.zeros(0, _U), np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.concatenate([[True], (low[1:] != low[:-1]) | (np.diff(place) > 1)])
    low, place = low[new], place[new]
    # the key holds the place modulo 2**24; it lies within the window
    pos = place + ((_U((1 << 24) - 1) - (low & _U((1 << 24) - 1))).astype(np.int64) - place) % (1 << 24)
    pos = np.unique(pos)
    return h[pos], pos, row[pos]


def context(pos: np.ndarray, start: np.ndarray, end: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """From where to where the windows that may pick an anchor at pos reach, inside their text."""
    return np.maximum(pos + gram - length, start), np.minimum(pos + length, end)


def core_spans(pos: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(CORES, anchors) starts and ends of the cores: k steps to the left and the rest to the right."""
    step = (length - gram) // CORES
    k = np.arange(CORES)[:, None]
    pos = np.atleast_1d(pos)
    return pos - k * step, pos + gram + (CORES - 1 - k) * step


def _direct_order(raw: bytes, text: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes sorted on depth bytes: by their first 16 as numbers, then ties by their bytes."""
    padded = np.concatenate([text, np.zeros(16, np.uint8)])
    view = np.lib.stride_tricks.sliding_window_view(padded, 8)
    one = np.ascontiguousarray(view[at]).view(">u8")[:, 0].astype(_U)
    two = np.ascontiguousarray(view[at + 8]).view(">u8")[:, 0].astype(_U)
    by = np.lexsort((two, one))
    at, one, two = at[by], one[by], two[by]
    tied = (one[1:] == one[:-1]) & (two[1:] == two[:-1])
    edge = np.flatnonzero(np.diff(np.concatenate([[False], tied, [False]]).astype(np.int8)))
    for a, b in zip(edge[::2].tolist(), (edge[1::2] + 1).tolist()):
        at[a:b] = sorted(at[a:b].tolist(), key=lambda i: raw[i + 16 : i + depth])
    return at


def suffix_array(text: np.ndarray, depth: int, low: np.ndarray | None = None, high: np.ndarray | None = None) -> np.ndarray:
    """Suffixes of text in order, compared on at least `depth` bytes (ties in any order); two-stage.

    The text must end with a byte smaller than all others. low, high: sort only the suffixes that
    start in these ranges, and the few after each range that they are induced from.
    """
    n = len(text)
    same = np.flatnonzero(np.concatenate([text[1:] != text[:-1], [True]]))
    stop = np.repeat(same, np.diff(same, prepend=-1))  # the last place of the run of equal bytes
    nxt = text[np.minimum(stop + 1, n - 1)]
    rising = nxt > text  # smaller than its successor
    rising[n - 1] = True  # the end is its own bucket's only one
    wanted = np.ones(n, bool)
    if low is not None:
        ups = np.flatnonzero(rising)
        until = ups[np.searchsorted(ups, high)]
        wanted = np.cumsum(np.bincount(low, minlength=n + 1) - np.bincount(until + 1, minlength=n + 1))[:n] > 0
    direct = _direct_order(text.tobytes(), text, np.flatnonzero(rising & wanted), depth)
    rank = np.empty(n, np.int64)
    count = np.bincount(text[wanted], minlength=256)
    tail = np.cumsum(count)
    bucket = text[direct]
    up = np.bincount(bucket, minlength=256)
    # the direct ones close their bucket
    rank[direct] = np.arange(len(direct)) - (np.cumsum(up) - up)[bucket] + (tail - up)[bucket]
    # the rest by buckets: first those whose successor lies in an earlier bucket, in its order,
    # then those of a run of this byte, each after the one it precedes
    falling = np.flatnonzero(~rising & wanted)
    run = (stop - np.arange(n))[falling]
    by = np.lexsort((run, text[falling]))
    falling, run = falling[by], run[by]
    code = text[falling].astype(np.int64) << 32 | run
    cuts = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(code) else np.zeros(0, np.int64)
    filled = tail - count
    for a, b in zip(cuts, np.append(cuts[1:], len(falling))):
        group = falling[a:b]
        c = int(text[group[0]])
        order = group[np.argsort(rank[group + 1], kind="stable")]
        rank[order] = filled[c] + np.arange(len(order))
        filled[c] += len(order)
    chosen = np.flatnonzero(wanted)
    out = np.empty(len(chosen), np.int64)
    out[rank[chosen]] = chosen
    return out


def equal_neighbours(text: np.ndarray, sa: np.ndarray, length: int, left: np.ndarray) -> np.ndarray:
    """Whether each suffix of sa shares `length` bytes with the next. left: bytes from each place to the end of its piece."""
    a, b, same = sa[:-1], sa[1:], np.zeros(len(sa), bool)
    live = np.flatnonzero((left[a] >= length) & (left[b] >= length))
    if not len(live):
        return same
    words = np.lib.stride_tricks.sliding_window_view(text, 8)
    x = np.ascontiguousarray(words[a[live] + length - 8]).view(_U)[:, 0]
    y = np.ascontiguousarray(words[b[live] + length - 8]).view(_U)[:, 0]
    live = live[x == y]
    # pairs next to each other in the text, as those of a repeated passage are, are compared as one stretch: each byte once
    live = live[np.lexsort((a[live], b[live] - a[live]))]
    x, apart = a[live], b[live] - a[live]
    first = np.flatnonzero(np.diff(x, prepend=-2) + len(text) * np.diff(apart, prepend=0) != 1)
    count = np.diff(first, append=len(live))
    size = count + length - 1
    piece = (np.cumsum(size) - size) // COMPARED
    cuts = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), len(first)]
    for lo, hi in zip(cuts, cuts[1:]):
        stretch, place = ragged(size[lo:hi])
        head = first[lo:hi][stretch]
        at = x[head] + place
        wrong = np.concatenate([[0], np.cumsum(text[at] != text[at + apart[head]])])
        stretch, nth = ragged(count[lo:hi])
        start = (np.cumsum(size[lo:hi]) - size[lo:hi])[stretch] + nth
        same[live[first[lo:hi][stretch] + nth][wrong[start + length] == wrong[start]]] = True
    return same


def find_repeats(pieces: list[bytes], places: np.ndarray, length: int, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(piece, start) of windows that occur at another place too, of those that start from low to high in each piece.

    places: where each piece lies in the corpus; pieces may overlap there, and a window that two
    pieces show of one place is one window.
    """
    raw = np.frombuffer(b"\xff".join(pieces) + b"\xff\x00", np.uint8)
    # UTF-8 has no byte above 0xF4: 255 ends a piece, and lifting the others leaves 0 for the end of all
    text = np.where(raw == 255, 255, np.minimum(raw, 253) + 1).astype(np.uint8)
    text[-1] = 0
    size = np.array([len(p) for p in pieces])
    begin = np.cumsum(size + 1) - (size + 1)
    piece, at = ragged(size + 1)
    left = np.append(size[piece] - at, 0)
    sa = suffix_array(text, length, begin + low, begin + high)
    same = equal_neighbours(text, sa, length, left)
    member = same.copy()
    member[1:] |= same[:-1]
    chosen = np.flatnonzero(member)
    if not len(chosen):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.concatenate([[True], ~same[chosen[1:] - 1]])
    start = sa[chosen]
    where = places[piece[start]] + at[start]
    first = np.flatnonzero(new)
    several = np.minimum.reduceat(where, first) != np.maximum.reduceat(where, first)
    hit = np.sort(start[several[np.cumsum(new) - 1]])
    return piece[hit], hit - begin[piece[hit]]


def _blocks(length: int, gram: int, owners: int):
    names = ["owner", "block", "wide", "narrow", "doc", "at"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, k = TaskContext.get().partitionId() << 24, 0
        held: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal k
            h, ctx, doc, key, pos = (np.concatenate(x) for x in list(zip(*held))[:5])
            cores = np.concatenate([x[5] for x in held], axis=1)
            held.clear()
            by = np.lexsort((ctx, h))
            h, ctx, doc, key, pos, cores = h[by], ctx[by], doc[by], key[by], pos[by], cores[:, by]
            cuts = np.searchsorted(((h >> _U(32)) * _U(owners)) >> _U(32), np.arange(owners + 1, dtype=_U))
            out = []
            for o in np.flatnonzero(np.diff(cuts)):
                s = slice(cuts[o], cuts[o + 1])
                new = np.concatenate([[True], (h[s][1:] != h[s][:-1]) | (ctx[s][1:] != ctx[s][:-1])])
                at = np.flatnonzero(new)
                wide = np.stack([h[s][at], ctx[s][at], doc[s][at].view(_U), key[s][at].view(_U)])
                narrow = np.concatenate([[np.diff(at, append=len(new)), pos[s][at]], cores[:, s][:, at]]).astype(np.uint32)
                out.append((int(o), base + k, pack(wide.ravel()), pack(narrow.ravel()), pack(np.stack([doc[s], key[s]]).ravel()), pack(np.stack([pos[s], np.cumsum(new) - 1]).astype(np.uint32).ravel())))
            k += 1
            cols = list(zip(*out)) or [[]] * 6
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), *[pa.binary()] * 4))], names)

        for t in slabs(batches, "text", 500_000):
            data, off = text_bytes(t["text"].combine_chunks())
            h, pos, row = anchors(data, off, length, gram)
            start, end = off[:-1][row], off[1:][row]
            a, b = context(pos, start, end, length, gram)
            left, right = core_spans(pos, length, gram)
            inside = (left >= start) & (right <= end)
            left, right = np.where(inside, left, pos), np.where(inside, right, pos)
            hashes = span_hash(data, np.concatenate([a, left.ravel()]), np.concatenate([b, right.ravel()]))
            ctx = mix(hashes[: len(pos)] + (pos - a).astype(_U))  # the same bytes around another place are another context
            cores = np.where(inside, hashes[len(pos) :].reshape(CORES, -1) >> _U(32) | _U(1), _U(0))
            ids, keys = t["doc_id"].to_numpy(), t["key"].to_numpy()
            held.append((h, ctx, ids[row], keys[row], pos - start, cores))
            size += len(data)
            if size >= BLOCK_BYTES:
                yield flush()
                size = 0
        if held:
            yield flush()

    return run


def _by_owner(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[dict]]]:
    """Rows of each owner; they come sorted by owner."""
    held: list[dict] = []
    for r in each_row(batches):
        if held and held[0]["owner"] != r["owner"]:
            yield held[0]["owner"], held
            held = []
        held.append(r)
    if held:
        yield held[0]["owner"], held


def _own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each entry of each block: 1 if its whole context occurs twice, else 0 (kind 0). And asks (kind 1): one
    place of each distinct context that shares a core with another, once for each core; ASK_ROWS in a row."""
    types = (pa.int32(), pa.int32(), pa.int64(), pa.binary())

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["owner", "kind", "block", "payload"])

    for owner, rows in _by_owner(batches):
        wide = lambda i: np.concatenate([unpack(r["wide"]).reshape(4, -1)[i] for r in rows])  # noqa: B023, E731
        narrow = lambda i: np.concatenate([unpack(r["narrow"]).reshape(2 + CORES, -1)[i] for r in rows])  # noqa: B023, E731
        size = [(len(r["wide"]) - 1) // 32 for r in rows]
        h, ctx = wide(0), wide(1)
        by = np.lexsort((ctx, h))
        h, ctx = h[by], ctx[by]
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (ctx[1:] != ctx[:-1])])
        first = np.flatnonzero(new)
        total = np.add.reduceat(narrow(0)[by].astype(np.int64), first)
        answer = np.empty(len(h), np.uint8)
        answer[by] = (total[np.cumsum(new) - 1] > 1).astype(np.uint8)
        told = [(owner, 0, r["block"], pack(a)) for r, a in zip(rows, np.split(answer, np.cumsum(size)[:-1])) if a.any()]
        if told:
            yield batch(told)
        one, h = by[first], h[first]
        del ctx, by, new, total, answer, told
        doc, key, pos = wide(2)[one], wide(3)[one], narrow(1)[one]
        for k in range(CORES):
            core = narrow(2 + k)[one]
            name = mix(h + (core.astype(_U) << _U(3) | _U(k)))
            _, group, count = np.unique(name, return_inverse=True, return_counts=True)
            i = np.flatnonzero((core > 0) & (count[group] > 1))
            for lo in range(0, len(i), ASK_ROWS):
                j = i[lo : lo + ASK_ROWS]
                asks = np.stack([name[j], doc[j], key[j], pos[j].astype(_U), np.full(len(j), k, _U), count[group[j]].astype(_U)])
                yield batch([(owner, 1, None, pack(asks.ravel()))])
    trim()


def _twice(length: int, gram: int):
    """Spans of contexts that occur twice whole: (doc_id, key, from, to), packed by document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in each_row(batches):
            doc, key = unpack(r["doc"]).reshape(2, -1)
            pos, nth = unpack(r["at"]).reshape(2, -1).astype(np.int64)
            hit = unpack(r["payload"])[nth] > 0
            yield _spans(doc[hit], key[hit], pos[hit] + gram - length, pos[hit] + length)

    return run


def _spans(doc: np.ndarray, key: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    """One row a document with its spans (starts, then ends) as an array."""
    by = np.lexsort((a, key, doc))
    doc, key, a, b = doc[by], key[by], np.maximum(a[by], 0), b[by]
    first = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])])) if len(doc) else np.zeros(0, np.int64)
    ends = np.append(first[1:], len(doc))
    spans = [pack(np.concatenate([a[s:e], b[s:e]]).astype(np.int64)) for s, e in zip(first, ends)]
    return pa.RecordBatch.from_arrays([pa.array(doc[first]), pa.array(key[first]), pa.array(spans, pa.binary())], ["doc_id", "key", "spans"])


def _asks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for r in each_row(batches):
        e = unpack(r["payload"]).reshape(6, -1)
        e = e[:, np.lexsort((e[2], e[1]))]
        doc, key = e[1], e[2]
        first = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])]))
        ends = np.append(first[1:], len(doc))
        asks = [pack(e[[0, 3, 4, 5], s:t].ravel()) for s, t in zip(first, ends)]
        yield pa.RecordBatch.from_arrays([pa.array(doc[first].view(np.int64)), pa.array(key[first].view(np.int64)), pa.array(asks, pa.binary())], ["doc_id", "key", "asks"])


def _windows(pos: np.ndarray, k: np.ndarray, begin: np.ndarray, end: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """The first and the last start of windows over the core, in a text of which the bytes from begin to end are there."""
    left, right = (x[k, np.arange(len(k))] for x in core_spans(pos, length, gram))
    low = np.maximum(right - length, begin)
    return low, np.maximum(np.minimum(left, end - length), low)


def _cut_out(length: int, gram: int, hot: int):
    """The bytes of the contexts asked for, by core; of a core with many contexts the windows over it, by core and
    hash range: rows without bytes, with packed documents, hashes, numbers of documents, and starts."""
    names = ["core", "part", "k", "doc_id", "key", "pos", "from", "bytes", "windows"]
    types = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
    over = length - gram - (CORES - 1) * ((length - gram) // CORES) + 1  # windows over a core

    def cut_windows(rows: list[tuple]) -> Iterator[tuple]:
        core, count, k, doc, key, pos, begin, raw, _ = zip(*rows)
        k, pos, begin = (np.array(x, np.int64) for x in (k, pos, begin))
        size = np.array([len(x) for x in raw])
        low, high = _windows(pos, k, begin, begin + size, length, gram)
        row, place = ragged(np.where(size >= length, high - low + 1, 0))
        start = low[row] + place
        at = start - begin[row] + (np.cumsum(size) - size)[row]
        h = span_hash(np.frombuffer(b"".join(raw), np.uint8), at, at + length)
        core, parts = np.array(core, np.int64)[row], (-(-np.array(count, np.int64) * over // HOT_WINDOWS))[row]
        part = (h % parts.astype(_U)).astype(np.int64)
        by = np.lexsort((part, core))
        new = np.flatnonzero(np.concatenate([[True], (np.diff(core[by]) != 0) | (np.diff(part[by]) != 0)])) if len(by) else []
        for a, b in zip(new, np.append(new[1:], len(by)).astype(int)):
            w = by[a:b]
            docs, nth = np.unique(row[w], return_inverse=True)
            ids = np.array([[doc[i], key[i]] for i in docs.tolist()], np.int64).T
            packed = struct.pack("<q", len(docs)) + ids.tobytes() + h[w].tobytes() + nth.astype(np.uint32).tobytes() + start[w].astype(np.uint32).tobytes()
            yield int(core[w[0]]), int(part[w[0]]), None, None, None, None, None, None, packed

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        many: list[tuple] = []

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            if len(many) > (0 if last else 3000):
                out.extend(cut_windows(many))
                many.clear()
            if len(out) > (0 if last else 3000):
                cols = list(zip(*out))
                out.clear()
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

        for whole in batches:
            for lo in range(0, whole.num_rows, 500):
                b = whole.slice(lo, 500)
                for doc, key, text, asks in zip(*[b.column(c).to_pylist() for c in ("doc_id", "key", "text", "asks")]):
                    raw = text.encode("utf-8", "surrogatepass")
                    for x in asks:
                        name, pos, k, count = unpack(x).reshape(4, -1)
                        k = k.astype(np.int64)
                        left, right = (v[k, np.arange(len(k))] for v in core_spans(pos.astype(np.int64), length, gram))
                        low, high = np.maximum(right - length, 0), np.minimum(left + length, len(raw))
                        for c, p, i, n, a, e in zip(*[v.tolist() for v in (name.view(np.int64), pos, k, count, low, high)]):
                            (many if n > hot else out).append((c, n if n > hot else 0, i, doc, key, p, a, raw[a:e], None))
                    yield from flush(False)
            trim()
        yield from flush(True)

    return run


def _joined(doc: np.ndarray, key: np.ndarray, start: np.ndarray, length: int) -> pa.RecordBatch:
    """Spans of repeated windows of (doc, key) by their starts."""
    by = np.lexsort((start, key, doc))
    doc, key, start = doc[by], key[by], start[by]
    new = np.concatenate([[True], (np.diff(start) > 1) | (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])]) if len(doc) else np.zeros(0, bool)
    s = np.flatnonzero(new)
    last = np.append(s[1:], len(doc))[: len(s)] - 1
    return _spans(doc[s], key[s], start[s], start[last] + length)


def _compare(length: int, gram: int):
    """Repeats among the contexts of each core; rows come sorted by core and part."""

    def sort(part: pa.Table) -> pa.RecordBatch:
        doc, key, begin = (part[c].to_numpy() for c in ("doc_id", "key", "from"))
        _, nth = np.unique(np.stack([doc, key], 1), axis=0, return_inverse=True)
        low, high, _, _ = windows(part)
        row, start = find_repeats(part["bytes"].to_pylist(), (nth.ravel().astype(np.int64) << 40) + begin, length, low - begin, high - begin)
        return _joined(doc[row], key[row], begin[row] + start, length)

    def windows(part: pa.Table) -> tuple[np.ndarray, ...]:
        """The first and the last start of windows over the core, in the document; where pieces begin and how long they are."""
        size = np.array([len(x) for x in part["bytes"].to_pylist()])
        begin, pos, k = (part[c].to_numpy().astype(np.int64) for c in ("from", "pos", "k"))
        return *_windows(pos, k, begin, begin + size, length, gram), begin, size

    def hashes(part: pa.Table) -> tuple[np.ndarray, ...]:
        """Windows over the core that fall to this part: hash, document, start."""
        found = []
        for raw in part["windows"].to_pylist():
            n = struct.unpack_from("<q", raw)[0]
            doc, key = np.frombuffer(raw, np.int64, 2 * n, 8).reshape(2, -1)
            m = (len(raw) - 8 - 16 * n) // 16
            h = np.frombuffer(raw, _U, m, 8 + 16 * n)
            nth, start = np.frombuffer(raw, np.uint32, 2 * m, 8 + 16 * n + 8 * m).reshape(2, -1)
            found.append((h, doc[nth], key[nth], start.astype(np.int64)))
        return tuple(np.concatenate(c) for c in zip(*found))

    def match(seen: list[tuple]) -> pa.RecordBatch:
        h, doc, key, start = (np.concatenate(x) for x in zip(*seen))
        place = mix(doc.view(_U) ^ mix(key.view(_U) + start.astype(_U)))
        by = np.lexsort((place, h))
        h, place, doc, key, start = h[by], place[by], doc[by], key[by], start[by]
        if not len(h):
            return _joined(doc, key, start, length)
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        several = place[first] != place[np.append(first[1:], len(h)) - 1]
        hit = np.repeat(several, np.diff(first, append=len(h)))
        return _joined(doc[hit], key[hit], start[hit], length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None  # whole cores to be sorted together
        seen: list[tuple] = []  # windows of the core that is compared by hash
        core = None
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                t = pa.Table.from_batches([batch.slice(lo, 500)])
                hot = t["windows"].is_valid().to_numpy(zero_copy_only=False)
                names = t["core"].to_numpy()
                for at in _runs(names, hot, t["part"].to_numpy()):
                    piece = t.slice(at[0], at[1] - at[0])
                    if hot[at[0]]:
                        name = (names[at[0]], piece["part"][0].as_py())
                        if name != core and seen:
                            yield match(seen)
                            seen = []
                        core = name
                        seen.append(hashes(piece))
                    else:
                        held = piece if held is None else pa.concat_tables([held, piece])
                        if held.nbytes > SORT_BYTES:
                            anchor = held["core"].to_numpy()
                            stop = int(np.searchsorted(-(anchor != anchor[-1]).astype(int), 0))
                            if stop:
                                yield sort(held.slice(0, stop).combine_chunks())
                                held = held.slice(stop).combine_chunks()
            trim()
        if seen:
            yield match(seen)
        if held is not None:
            yield sort(held.combine_chunks())
        trim()

    return run


def _runs(core: np.ndarray, hot: np.ndarray, part: np.ndarray) -> list[tuple[int, int]]:
    """Runs of rows: of one hot core and part, or of cores that are not hot."""
    new = np.flatnonzero((hot[1:] != hot[:-1]) | (hot[1:] & ((core[1:] != core[:-1]) | (part[1:] != part[:-1])))) + 1
    cuts = [0, *new.tolist(), len(core)]
    return [(a, b) for a, b in zip(cuts, cuts[1:]) if b > a]


def _strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for doc, text, spans in zip(*[b.column(c).to_pylist() for c in ("doc_id", "text", "spans")]):
            raw = text.encode("utf-8", "surrogatepass")
            parts, at, runs, gone = [], 0, 0, 0
            for a, e in _union(spans, len(raw)):
                parts.append(raw[at:a])
                runs, gone, at = runs + 1, gone + e - a, e
            kept = b"".join([*parts, raw[at:]])
            out.append((doc, len(raw), gone, runs, hashlib.sha256(kept).hexdigest(), kept))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def _union(spans: list[bytes] | None, size: int) -> list[tuple[int, int]]:
    """Maximal runs of the spans, inside a text of this size."""
    if not spans:
        return []
    both = [unpack(s).reshape(2, -1) for s in spans]
    a = np.concatenate([x[0] for x in both])
    e = np.minimum(np.concatenate([x[1] for x in both]), size)
    by = np.argsort(a, kind="stable")
    a, e = a[by], np.maximum.accumulate(e[by])
    new = np.concatenate([[True], a[1:] > e[:-1]])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(a)) - 1
    return list(zip(a[first].tolist(), e[last].tolist()))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM, hot: int = HOT, keep_bytes: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and `kept`, what is left).

    Every byte in a window of `length` bytes that starts anywhere else too goes, in all its
    places. Texts shorter than that, empty and null ones stay as they are; rows that repeat
    exactly repeat each other's windows. An empty table gives no rows; ids are integers (null
    allowed). What is left need not be UTF-8, so it is binary.
    """
    spark = docs.sparkSession
    if not 8 <= gram <= length - CORES:
        raise ValueError("gram must lie between 8 and length - CORES")
    source = docs.select(F.col(id_col).cast("long").alias("id"), whole_text(docs, text).alias("text"))
    source = source.select(F.coalesce("id", F.lit(-(1 << 63))).alias("doc_id"), F.xxhash64("id", "text").alias("key"), "text")
    total = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    owners = int(min(1 << 20, max(tasks_for(spark), total * 2 // (length - gram + 2) // OWNER_ANCHORS + 1)))
    blocks = cut(source.mapInArrow(_blocks(length, gram, owners), "owner int, block long, wide binary, narrow binary, doc binary, at binary"))
    sent = blocks.select("owner", "block", "wide", "narrow").repartition(owners, "owner").sortWithinPartitions("owner", "block")
    owned = cut(sent.mapInArrow(_own, "owner int, kind int, block long, payload binary"))
    twice = blocks.select("owner", "block", "doc", "at").join(owned.where("kind = 0").select("owner", "block", "payload"), ["owner", "block"])
    spans = twice.mapInArrow(_twice(length, gram), "doc_id long, key long, spans binary")
    # contexts that share a core with a different one
    asks = cut(owned.where("kind = 1").select("payload").mapInArrow(_asks, "doc_id long, key long, asks binary").groupBy("doc_id", "key").agg(F.collect_list("asks").alias("asks")))
    few = asks.count() <= BROADCAST_ROWS
    one = source.join(F.broadcast(asks.select("doc_id", "key")) if few else asks.select("doc_id", "key"), ["doc_id", "key"], "left_semi").dropDuplicates(["doc_id", "key"])
    pieces = one.join(asks, ["doc_id", "key"]).mapInArrow(_cut_out(length, gram, hot), "core long, part int, k int, doc_id long, key long, pos long, from long, bytes binary, windows binary")
    by_core = pieces.repartition(max(owners, tasks_for(spark)), "core", "part").sortWithinPartitions("core", "part")
    spans = spans.union(by_core.mapInArrow(_compare(length, gram), "doc_id long, key long, spans binary"))
    by_doc = cut(spans.groupBy("doc_id", "key").agg(F.collect_list("spans").alias("spans")))
    out = source.join(by_doc, ["doc_id", "key"], "left").select("doc_id", "text", "spans").mapInArrow(_strip, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    out = out.withColumn("doc_id", F.when(F.col("doc_id") != -(1 << 63), F.col("doc_id")))
    return out if keep_bytes else out.drop("kept")


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(COALESCE(text, ''))) AS h, octet_length(encode(COALESCE(text, ''))) AS n FROM documents),
w AS (SELECT r, i, md5_number(substring(h, 2 * i + 1, 800)) AS k FROM (SELECT r, h, unnest(range(0, n - 399)) AS i FROM d)),
g AS (SELECT r, i FROM w WHERE k IN (SELECT k FROM w GROUP BY k HAVING count(*) > 1)),
b AS (SELECT r, i, CASE WHEN i <= lag(i) OVER (PARTITION BY r ORDER BY i) + 400 THEN 0 ELSE 1 END AS new FROM g),
u AS (SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i) AS island FROM b),
s AS (SELECT r, min(i) AS a, max(i) + 400 AS e FROM u GROUP BY r, island),
t AS (SELECT r, sum(e - a) AS gone, count(*) AS spans, max(e) AS last FROM s GROUP BY r),
kept AS (SELECT r, COALESCE(lag(e) OVER (PARTITION BY r ORDER BY a), 0) AS a, a AS e FROM s UNION ALL SELECT t.r, last, n FROM t JOIN d USING (r)),
k AS (SELECT r, string_agg(substring(h, 2 * a + 1, 2 * (e - a)), '' ORDER BY a) AS h FROM kept JOIN d USING (r) GROUP BY r)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(COALESCE(gone, 0) AS BIGINT) AS n_removed, CAST(COALESCE(spans, 0) AS BIGINT) AS n_spans, sha256(unhex(COALESCE(k.h, d.h))) AS kept_sha256
FROM d LEFT JOIN t USING (r) LEFT JOIN k USING (r)
"""


def query(spark, sf_dir):
    """op6: all documents."""
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
