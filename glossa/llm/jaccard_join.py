"""Operator 10: n-gram Jaccard join by multiple global orders.

Documents are sets of 5-word shingles. Under any global order of shingles, two sets with
Jaccard similarity of at least t share one of the first n - ceil(t n) + 1 shingles of each
(prefix filter). Several orders are used: one that puts shingles known to be frequent last and
is indexed, and orders by independent hashes; a candidate pair must meet under all of them
before its texts move and its sets are compared.

To find all links without all pairs of a group:
1. Documents of one set are one node. Prefixes go to buckets of shingles as packed arrays;
   buckets keep the groups of two nodes and more.
2. Star round: each group ties its members to one leader. Links that verify give components,
   which takes up copies and near copies, however many, in pairs linear in their number.
3. Cross round: only pairs of different components that meet under all orders are verified.
A pair inside one component needs no check, so after the two rounds no link is missing.

A pair that meets in the index must first pass a bound on the symmetric difference: documents
carry the parities of hash classes of their shingles (about a bit a shingle), and the parities
that differ are never more than the shingles that do. The prefixes under the orders by hash are
cut only of documents in pairs that pass, and intersected.

Filters work on 48-bit hashes of shingles, which can only let a pair pass that need not.
Verification compares the words themselves. Documents are one node if two independent 64-bit
hashes of their sets agree; if only one of them does, other hashes are tried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.llm.common import each_row, find_words, lower, mix, pack, ragged, shingle_hashes, slabs, span_hash, spare, tasks_for, text_bytes, trim, unpack, whole_text
from glossa.operators.graph import connected_components
from glossa.session import cut

WIDTH, PERCENT = 5, 80
#: Frequent shingles that both orders put last; only the order, not the result, depends on them, so the list may be bounded.
FREQUENT = 1 << 19
#: Bytes of text in a chunk, postings in a bucket, postings in a row of groups.
CHUNK_BYTES, BUCKET_POSTINGS, ROW_POSTINGS = 8_000_000, 1_000_000, 60_000
#: Ids of documents whose texts are asked for (some 40 bytes each) are broadcast up to this many; beyond it they are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: Nodes that one owner answers for.
OWNER_NODES = 20_000
#: Orders by hash that candidates must meet under, besides the indexed one.
HASH_ORDERS = 2
#: Parity bits of a document: the power of two from its number of shingles up, within these.
LEAST_BITS, MOST_BITS = 256, 1 << 15
#: Seeds that are tried for the hashes that tell sets apart; bits of a node's id (fewer in tests of collisions).
SEEDS, ALL_BITS = 8, np.uint64((1 << 64) - 1)
NODE_BITS = ALL_BITS
#: Shingles of texts that a task remembers while it compares pairs.
KNOWN = 200_000
_MASK = np.uint64((1 << 48) - 1)
_U = np.uint64


def shingle_sets(column: pa.Array, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct 48-bit shingles of each text one after another, how many before each text). At most 65,535 texts."""
    data, off = text_bytes(column)
    data = lower(data)
    start, end, before = find_words(data, off)
    h, row = shingle_hashes(span_hash(data, start, end), before, width)
    key = np.sort(row.astype(_U) << _U(48) | h >> _U(16))
    if len(key):
        key = key[np.concatenate([[True], key[1:] != key[:-1]])]
    return key & _MASK, np.searchsorted(key, np.arange(len(off), dtype=_U) << _U(48))


def _nodes(sets: np.ndarray, before: np.ndarray, seed: int, mask: np.uint64) -> np.ndarray:
    """An id of each set: equal sets, equal ids. Seeds give independent ids."""
    n = np.diff(before)
    total = np.concatenate([[_U(0)], np.cumsum(mix(sets + _U(0x5851F42D4C957F2D * (2 * seed + 1) % (1 << 64))), dtype=_U)])
    return mix((total[before[1:]] - total[before[:-1]]) + n.astype(_U) * _U(0x2545F4914F6CDD1D)) & mask


def _parities(sets: np.ndarray, before: np.ndarray) -> list[bytes]:
    """The parities of each set: how many of its shingles fall in each hash class, modulo 2."""
    h = mix(sets ^ _U(0x6A09E667F3BCC909))
    bits = _classes(np.diff(before))
    out: list[bytes | None] = [None] * len(bits)
    for size in np.unique(bits).tolist():
        docs = np.flatnonzero(bits == size)
        step = max(1, (1 << 20) // size)
        for a in range(0, len(docs), step):
            d = docs[a : a + step]
            n = (before[1:] - before[:-1])[d]
            row, place = ragged(n)
            at = (h[before[d][row] + place] & _U(size - 1)).astype(np.int64)
            odd = np.bincount(row * size + at, minlength=len(d) * size).reshape(len(d), size) & 1
            for k, raw in zip(d.tolist(), np.packbits(odd.astype(np.uint8), axis=1)):
                out[k] = raw.tobytes()
    return out


def _classes(n: np.ndarray) -> np.ndarray:
    return np.clip(1 << np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64), LEAST_BITS, MOST_BITS)


class Parities:
    """Sizes and parities of documents, to tell pairs that cannot link. A longer row of parities
    folds to a shorter one, as its classes are hashes modulo a power of two."""

    def __init__(self, n: np.ndarray, raw: list[bytes], percent: int):
        self.n, self.percent = n, percent
        self.words = np.array([len(r) // 8 for r in raw], np.int64)
        self.at = np.zeros(len(raw), np.int64)
        self.table: dict[int, np.ndarray] = {}
        for w in np.unique(self.words).tolist():
            mine = np.flatnonzero(self.words == w)
            self.at[mine] = np.arange(len(mine))
            self.table[w] = np.frombuffer(b"".join(raw[k] for k in mine), _U).reshape(-1, w)

    def _rows(self, i: np.ndarray, w: int) -> np.ndarray:
        out = np.empty((len(i), w), _U)
        for size in np.unique(self.words[i]).tolist():
            on = self.words[i] == size
            x = self.table[size][self.at[i[on]]]
            while x.shape[1] > w:
                x = x[:, : x.shape[1] // 2] ^ x[:, x.shape[1] // 2 :]
            out[on] = x
        return out

    def near(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether each pair may link; never false for a pair that does."""
        most = (100 - self.percent) * (self.n[i] + self.n[j]) // (100 + self.percent)
        ok = np.abs(self.n[i] - self.n[j]) <= most
        width = np.minimum(self.words[i], self.words[j])
        for w in np.unique(width[ok]).tolist():
            these = np.flatnonzero(ok & (width == w))
            for a in range(0, len(these), max(1, (1 << 19) // w)):
                k = these[a : a + max(1, (1 << 19) // w)]
                ok[k] = np.bitwise_count(self._rows(i[k], w) ^ self._rows(j[k], w)).sum(1, dtype=np.int64) <= most[k]
        return ok


def _size_key(n: np.ndarray) -> np.ndarray:
    """The size on a logarithmic scale: sets whose keys differ by more than _gap() are too unlike in size."""
    return np.minimum(np.log(np.maximum(n, 1)) * 2000, 65535).astype(np.uint16)


def _gap(percent: int) -> int:
    return int(np.ceil(np.log(100 / percent) * 2000)) + 1


def _first(nodes: np.ndarray) -> np.ndarray:
    """Whether each is the first of its value."""
    keep = np.zeros(len(nodes), bool)
    keep[np.unique(nodes, return_index=True)[1]] = True
    return keep


def _sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
    for t in slabs(batches, "text", 2_000_000):
        for a in range(0, t.num_rows, 60_000):
            part = t.slice(a, 60_000).combine_chunks()
            yield part, *shingle_sets(part["text"].combine_chunks(), width)


def _describe(width: int, owners: int, seed: int):
    """Rows of documents (kind 0) and, for owners, shingles that a chunk holds more than once (kind 1)."""
    names = ["kind", "doc_id", "key", "key2", "n", "node", "check", "bits", "owner", "token", "count"]
    mask = NODE_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        seen: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch | None:
            nodes, sets = np.concatenate(seen), held.copy()
            held.clear()
            seen.clear()
            keep = _first(nodes)
            token = np.sort(np.concatenate([s for s, k in zip(sets, keep) if k] or [np.zeros(0, _U)]))
            if not len(token):
                return None
            at = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
            count = np.diff(at, append=len(token))
            token, count = token[at][count > 1], count[count > 1].astype(np.uint32)
            cuts = np.searchsorted((token * _U(owners)) >> _U(48), np.arange(owners + 1, dtype=_U)) if owners < 65536 else None
            full = np.flatnonzero(np.diff(cuts))
            k = len(full)
            none = pa.nulls(k, pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(np.ones(k), pa.int32()), none, none, none, none, none, none, pa.nulls(k, pa.binary()), pa.array(full, pa.int32()),
                pa.array([pack(token[cuts[o] : cuts[o + 1]]) for o in full], pa.binary()), pa.array([pack(count[cuts[o] : cuts[o + 1]]) for o in full], pa.binary())], names)

        for t, sets, before in _sets(batches, width):
            n, nodes = np.diff(before), _nodes(sets, before, seed, mask)
            k = t.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(k), pa.int32()), t["doc_id"].combine_chunks(), t["key"].combine_chunks(), t["key2"].combine_chunks(), pa.array(n, pa.int64()), pa.array(nodes.view(np.int64)), pa.array(_nodes(sets, before, SEEDS + seed, ALL_BITS).view(np.int64)),
                pa.array(_parities(sets, before), pa.binary()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary()), pa.nulls(k, pa.binary())], names)
            held += np.split(sets, before[1:-1])
            seen.append(nodes)
            size += t.nbytes
            if size > CHUNK_BYTES:
                if (b := flush()) is not None:
                    yield b
                size = 0
        if seen and (b := flush()) is not None:
            yield b

    return run


def _top(token: np.ndarray, count: np.ndarray) -> np.ndarray:
    return np.lexsort((token, -count.astype(np.int64)))[:FREQUENT]


def _sum_counts(pdf: pd.DataFrame) -> pd.DataFrame:
    token, inverse = np.unique(np.concatenate([unpack(x) for x in pdf["token"]]), return_inverse=True)
    count = np.bincount(inverse, np.concatenate([unpack(x) for x in pdf["count"]])).astype(np.int64)
    best = _top(token, count)
    best = best[count[best] >= 4]
    return pd.DataFrame({"token": [pack(token[best])], "count": [pack(count[best])]})


def _merge_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    token, count = np.zeros(0, _U), np.zeros(0, np.int64)
    for r in each_row(batches):
        token, count = np.concatenate([token, unpack(r["token"])]), np.concatenate([count, unpack(r["count"])])
        best = _top(token, count)
        token, count = token[best], count[best]
    if len(token):
        yield pa.RecordBatch.from_arrays([pa.array([pack(token)], pa.binary()), pa.array([pack(count)], pa.binary())], ["token", "count"])


def _frequent(described: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted frequent shingles and their classes (1 to 15, by the logarithm of the count)."""
    sums = described.where("kind = 1").groupBy("owner").applyInPandas(_sum_counts, "token binary, count binary")
    rows = sums.repartition(8).mapInArrow(_merge_counts, "token binary, count binary").collect()
    token = np.concatenate([unpack(r["token"]) for r in rows]) if rows else np.zeros(0, _U)
    count = np.concatenate([unpack(r["count"]) for r in rows]) if rows else np.zeros(0, np.int64)
    best = _top(token, count)
    best = best[np.argsort(token[best])]
    return token[best], np.clip(np.log2(np.maximum(count[best], 1)) - 1, 1, 15).astype(_U)


def prefix_lengths(n: np.ndarray, percent: int) -> np.ndarray:
    return np.where(n > 0, n - -(-n * percent // 100) + 1, 0)


def _prefixes(sets: np.ndarray, before: np.ndarray, frequent: np.ndarray, classes: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(44-bit token, text) of the first shingles of each text under the indexed order."""
    doc = ragged(np.diff(before))[0]
    cls = np.zeros(len(sets), _U)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, sets), len(frequent) - 1)
        cls = np.where(frequent[at] == sets, classes[at], _U(0))
    key = np.sort(doc.astype(_U) << _U(48) | cls << _U(44) | mix(sets) >> _U(20))
    row, place = ragged(prefix_lengths(np.diff(before), percent))
    return key[before[:-1][row] + place] & _U((1 << 44) - 1), row


def _hash_orders(width: int, percent: int):
    """(node, prefixes): the first shingles of each text under the orders by hash, as sorted 32-bit values one order after another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, sets, before in _sets(batches, width):
            length = prefix_lengths(np.diff(before), percent)
            row, place = ragged(length)
            parts = []
            for o in range(HASH_ORDERS):
                doc = ragged(np.diff(before))[0]
                key = np.sort(doc.astype(_U) << _U(48) | mix(sets + _U((o + 1) << 50)) >> _U(16))
                parts.append(((key[before[:-1][row] + place] & _MASK) >> _U(16)).astype(np.uint32))
            cuts = np.cumsum(length)[:-1]
            each = [np.split(p, cuts) for p in parts]
            yield _batch([(n, pack(np.concatenate(x))) for n, *x in zip(t["node"].to_pylist(), *each)], ["node", "prefixes"], [pa.int64(), pa.binary()])

    return run


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs that share a first shingle under every order by hash."""
    for b in batches:
        keep = []
        for i, (x, y) in enumerate(zip(b.column("prefixes_a").to_pylist(), b.column("prefixes_b").to_pylist())):
            if all(_common(u, v) for u, v in zip(unpack(x).reshape(HASH_ORDERS, -1), unpack(y).reshape(HASH_ORDERS, -1))):
                keep.append(i)
        keep = pa.array(keep, pa.int64())
        yield pa.RecordBatch.from_arrays([b.column("a").take(keep), b.column("b").take(keep)], ["a", "b"])


def _postings(shared, width: int, percent: int, buckets: int, seed: int):
    names = ["bucket", "token", "node", "size"]
    mask = NODE_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, classes = shared.value
        held: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            token, node, q = (np.concatenate(x) for x in zip(*held))
            held.clear()
            scaled = token * _U(buckets)
            bucket, rest = (scaled >> _U(44)).astype(np.int64), ((scaled & _U((1 << 44) - 1)) >> _U(12)).astype(np.uint32)
            by = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[by], np.arange(buckets + 1))
            full = np.flatnonzero(np.diff(cuts))
            cols = [[pack(x[by[cuts[k] : cuts[k + 1]]]) for k in full] for x in (rest, node, q)]
            return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), *[pa.array(c, pa.binary()) for c in cols]], names)

        for t, sets, before in _sets(batches, width):
            nodes, q = _nodes(sets, before, seed, mask), _size_key(np.diff(before))
            keep = _first(nodes)
            token, row = _prefixes(sets, before, frequent, classes, percent)
            use = keep[row]
            held.append((token[use], nodes[row[use]], q[row[use]]))
            size += t.nbytes
            if size > CHUNK_BYTES:
                yield flush()
                size = 0
        if held:
            yield flush()

    return run


def _groups(pdf: pd.DataFrame) -> pd.DataFrame:
    """Groups of two nodes or more that share a token, as packed arrays."""
    token, node, q = (np.concatenate([unpack(x) for x in pdf[c]]) for c in ("token", "node", "size"))
    by = np.argsort(token, kind="stable")
    s = token[by]
    twice = np.concatenate([[False], s[1:] == s[:-1]])
    twice[:-1] |= twice[1:]
    by = by[twice]
    by = by[np.lexsort((node[by], token[by]))]
    token, node, q = token[by], node[by], q[by]
    if len(token):
        new = np.concatenate([[True], (token[1:] != token[:-1]) | (node[1:] != node[:-1])])
        token, node, q = token[new], node[new], q[new]
    first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]])) if len(token) else np.zeros(0, np.int64)
    size = np.diff(first, append=len(token))
    many = np.repeat(size > 1, size)
    node, q, size = node[many], q[many], size[size > 1]
    out = []
    ends = np.cumsum(size)
    a = 0
    while a < len(size):  # rows of whole groups
        base = ends[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(ends, base + ROW_POSTINGS, side="right")))
        out.append((pack(size[a:b]), pack(node[base : ends[b - 1]]), pack(q[base : ends[b - 1]])))
        a = b
    return pd.DataFrame(out, columns=["sizes", "node", "size"])


def _degrees(groups: DataFrame, owners: int) -> DataFrame:
    """(node, degree): how many others each node meets in all groups. Summed by owners of nodes, from packed parts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in each_row(batches):
            sizes, node = unpack(r["sizes"]), unpack(r["node"])
            x, which = np.unique(node, return_inverse=True)
            degree = np.bincount(which, np.repeat(sizes - 1, sizes)).astype(np.int64)
            yield _batch(list(_by_owner(x.view(np.int64), owners, degree)), ["owner", "node", "degree"], [pa.int32(), pa.binary(), pa.binary()])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        x, which = np.unique(np.concatenate([unpack(n) for n in pdf["node"]]), return_inverse=True)
        return pd.DataFrame({"node": x, "degree": np.bincount(which, np.concatenate([unpack(v) for v in pdf["degree"]])).astype(np.int64)})

    parts = groups.select("sizes", "node").mapInArrow(count, "owner int, node binary, degree binary")
    return parts.groupBy("owner").applyInPandas(add, "node long, degree long")


def _star(gap: int, owners: int):
    """Ties the members of each group to the one that meets most others anywhere, near copies' likeliest centre."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in each_row(batches):
            sizes, node, q = unpack(r["sizes"]), unpack(r["node"]), unpack(r["size"]).astype(np.int64)
            told = Told(r["of"])
            degree = told.value[np.searchsorted(told.node, node.view(np.int64))]
            group = ragged(sizes)[0]
            lead = np.lexsort((mix(node), -degree, group))[np.cumsum(sizes) - sizes][group]
            ok = (node[lead] != node) & (np.abs(q[lead] - q) <= gap)
            yield _packed_pairs(node[lead[ok]], node[ok], owners)

    return run


def _packed_pairs(a: np.ndarray, b: np.ndarray, owners: int) -> pa.RecordBatch:
    """Distinct pairs, packed by owner of the pair."""
    a, b = a.view(np.int64), b.view(np.int64)
    by = np.lexsort((b, a))
    a, b = a[by], b[by]
    new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.zeros(0, bool)
    a, b = a[new], b[new]
    key = mix(a.view(_U) ^ mix(b.view(_U))).view(np.int64)
    return _batch([(o, x, y) for o, _, x, y in _by_owner(key, owners, a, b)], ["owner", "a", "b"], [pa.int32(), pa.binary(), pa.binary()])


def _distinct_pairs(packed: DataFrame) -> DataFrame:
    """(a, b), each once."""

    def once(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = (np.concatenate([unpack(x) for x in pdf[c]]) for c in ("a", "b"))
        by = np.lexsort((b, a))
        a, b = a[by], b[by]
        new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        return pd.DataFrame({"a": a[new], "b": b[new]})

    return packed.groupBy("owner").applyInPandas(once, "a long, b long")


def _partners(group: np.ndarray, q: np.ndarray, gap: int) -> tuple[np.ndarray, np.ndarray]:
    """For nodes sorted by group and size: the first and the last of those like enough in size."""
    place = group * (1 << 20) + q
    return np.searchsorted(place, place - gap), np.searchsorted(place, place + gap, side="right") - 1


def _mixed(gap: int):
    """Of rows of groups, the nodes with a partner of another component and like size, by group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in each_row(batches):
            sizes, node, q = unpack(r["sizes"]), unpack(r["node"]), unpack(r["size"]).astype(np.int64)
            told = Told(r["of"])
            comp = node.view(np.int64).copy()
            if len(told.node):
                at = np.minimum(np.searchsorted(told.node, comp), len(told.node) - 1)
                comp = np.where(told.node[at] == comp, told.value[at], comp)
            group = ragged(sizes)[0]
            by = np.lexsort((q, group))
            group, q, node, comp = group[by], q[by], node[by], comp[by]
            low, high = _partners(group, q, gap)
            # the components within reach are all one's own if they change nowhere in between
            change = np.concatenate([[0], np.cumsum(comp[1:] != comp[:-1])])
            use = change[high] != change[low]
            if use.any():
                sizes = np.bincount(group[use])
                sizes = sizes[sizes > 0]
                cols = [pack(x) for x in (sizes, node[use], q[use].astype(np.uint16), comp[use])]
                yield _batch([(r["row"], *cols)], ["row", "sizes", "node", "size", "comp"], [pa.int64(), *[pa.binary()] * 4])

    return run


def _cross(gap: int, percent: int, owners: int):
    """Pairs of different components inside groups whose sizes and parities let them link, each once a row of groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in each_row(batches):
            sizes, node, q, comp = unpack(r["sizes"]), unpack(r["node"]), unpack(r["size"]).astype(np.int64), unpack(r["comp"])
            told = Told(r["of"])
            marks = Parities(told.value, told.bits, percent)
            at = np.searchsorted(told.node, node.view(np.int64))
            group = ragged(sizes)[0]
            by = np.lexsort((q, group))
            at, node, q, comp, group = at[by], node[by], q[by], comp[by], group[by]
            n = _partners(group, q, gap)[1] - np.arange(len(node))  # partners of no smaller size
            total = np.cumsum(n)
            a = 0
            while a < len(node):  # a bounded number of comparisons at a time
                b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + 200_000, side="right")))
                x, k = ragged(n[a:b])
                x += a
                y = x + 1 + k
                ok = comp[x] != comp[y]
                x, y = x[ok], y[ok]
                ok = marks.near(at[x], at[y])
                u, v = node[x[ok]].view(np.int64), node[y[ok]].view(np.int64)
                yield _packed_pairs(np.minimum(u, v), np.maximum(u, v), owners)
                a = b

    return run


def _bound(percent: int):
    """Pairs (a, b) whose sizes and parities let them link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = b.num_rows
            n = np.concatenate([b.column("n_a").to_numpy(), b.column("n_b").to_numpy()])
            told = Parities(n, b.column("bits_a").to_pylist() + b.column("bits_b").to_pylist(), percent)
            ok = told.near(np.arange(m), np.arange(m, 2 * m))
            keep = pa.array(np.flatnonzero(ok))
            yield pa.RecordBatch.from_arrays([b.column("a").take(keep), b.column("b").take(keep)], ["a", "b"])

    return run


def _likely(pairs: DataFrame, info: DataFrame, percent: int) -> DataFrame:
    a = info.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("bits").alias("bits_a"))
    b = info.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("bits").alias("bits_b"))
    return pairs.join(b, "b").join(a, "a").mapInArrow(_bound(percent), "a long, b long")


def _owner(node: np.ndarray, owners: int) -> np.ndarray:
    return (mix(node.view(_U) + _U(99)) % _U(owners)).astype(np.int64)


def _by_owner(node: np.ndarray, owners: int, *more: np.ndarray) -> Iterator[tuple]:
    """(owner, packed nodes, packed further arrays) of the owners that have any."""
    by = np.argsort(_owner(node, owners), kind="stable")
    cuts = np.searchsorted(_owner(node, owners)[by], np.arange(owners + 1))
    for o in np.flatnonzero(np.diff(cuts)):
        mine = by[cuts[o] : cuts[o + 1]]
        yield (int(o), pack(node[mine]), *[pack(x[mine]) for x in more])


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)


def _attach(rows: DataFrame, info: DataFrame, value: str, owners: int) -> DataFrame:
    """Rows of groups with `of`: what info says of their nodes, as packed arrays (node, value, bits).

    An exchange by owners of nodes: a row asks each owner once for all of its nodes.
    """
    bits = "bits" in info.columns

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in each_row(batches):
            x = np.unique(unpack(r["node"])).view(np.int64)
            yield _batch([(o, r["row"], n) for o, n in _by_owner(x, owners)], ["owner", "row", "asked"], [pa.int32(), pa.int64(), pa.binary()])

    def know(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            node, v = b.column("node").to_numpy(), b.column("value").to_numpy()
            raw = b.column("bits").to_pylist() if bits else None
            out = []
            for o, n, w, i in _by_owner(node, owners, v, np.arange(len(node))):
                mine = [raw[k] for k in unpack(i).tolist()] if bits else []
                out.append((o, n, w, pack(np.array([len(x) for x in mine], np.int64)), b"".join(mine)))
            yield _batch(out, ["owner", "node", "value", "lens", "bits"], [pa.int32(), *[pa.binary()] * 4])

    def answer(asked: pd.DataFrame, have: pd.DataFrame) -> pd.DataFrame:
        names = ["row", "node", "value", "lens", "bits"]
        if not len(asked) or not len(have):
            return pd.DataFrame({n: [] for n in names}).astype({"row": np.int64})
        told = Told([have.iloc[i].to_dict() for i in range(len(have))])
        out = []
        for row, x in zip(asked["row"], asked["asked"]):
            x = unpack(x)
            at = np.minimum(np.searchsorted(told.node, x), len(told.node) - 1)
            at = at[told.node[at] == x]
            if len(at):
                mine = [told.bits[k] for k in at.tolist()] if bits else []
                out.append((row, pack(told.node[at]), pack(told.value[at]), pack(np.array([len(m) for m in mine], np.int64)), b"".join(mine)))
        return pd.DataFrame(out, columns=names)

    asks = rows.select("row", "node").mapInArrow(ask, "owner int, row long, asked binary")
    known = info.select("node", F.col(value).alias("value"), *(["bits"] if bits else [])).mapInArrow(know, "owner int, node binary, value binary, lens binary, bits binary")
    told = asks.groupBy("owner").cogroup(known.groupBy("owner")).applyInPandas(answer, "row long, node binary, value binary, lens binary, bits binary")
    return rows.join(told.groupBy("row").agg(F.collect_list(F.struct("node", "value", "lens", "bits")).alias("of")), "row", "left")


class Told:
    """Packed answers as arrays sorted by node."""

    def __init__(self, answers: list[dict] | None):
        answers = answers or []
        node = np.concatenate([unpack(a["node"]) for a in answers]) if answers else np.zeros(0, np.int64)
        value = np.concatenate([unpack(a["value"]) for a in answers]) if answers else np.zeros(0, np.int64)
        by = np.argsort(node)
        self.node, self.value = node[by], value[by]
        bits: list[bytes] = []
        for a in answers:
            ends = np.cumsum(unpack(a["lens"])).tolist()
            bits += [a["bits"][s:e] for s, e in zip([0, *ends], ends)]
        self.bits = [bits[k] for k in by.tolist()] if bits else []


def word_shingles(text: str, width: int, numbers: dict[bytes, int]) -> np.ndarray:
    """The distinct shingles of a text, sorted, as numbers of their words; numbers: those given out so far."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.uint32, len(words))
    if len(ids) < width:
        ids = np.concatenate([ids, np.full(width - len(ids), 0xFFFFFFFF, np.uint32)]) if len(ids) else ids
    rows = np.lib.stride_tricks.sliding_window_view(ids, width) if len(ids) else np.zeros((0, width), np.uint32)
    return np.unique(np.ascontiguousarray(rows).view(np.dtype((np.void, 4 * width))).ravel())


def _verify(width: int, percent: int):
    """Pairs that link, by the words of their whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}
        numbers: dict[bytes, int] = {}
        held = 0
        for batch in batches:
            keep = []
            for i in range(batch.num_rows):
                pair = []
                for name, column in (("a", "text_a"), ("b", "text_b")):
                    node = batch.column(name)[i].as_py()
                    if node not in known:
                        known[node] = word_shingles(batch.column(column)[i].as_py(), width, numbers)
                        held += len(known[node])
                    pair.append(known[node])
                both = len(np.intersect1d(*pair, assume_unique=True))
                if 100 * both >= percent * (len(pair[0]) + len(pair[1]) - both):
                    keep.append(i)
                if held > KNOWN:
                    known, numbers, held = {}, {}, 0
            keep = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("a").take(keep), batch.column("b").take(keep)], ["a", "b"])
            trim()

    return run


def _common(s: np.ndarray, t: np.ndarray) -> int:
    """How many values two sorted sets share."""
    if not len(s) or not len(t):
        return 0
    at = np.minimum(np.searchsorted(s, t), len(s) - 1)
    return int((s[at] == t).sum())


def _texts(pairs: DataFrame, source: DataFrame, reps: DataFrame) -> DataFrame:
    """(node, text) of one document of each node in the pairs; nodes whose document's row repeats come that often.

    A document is found by its id, which may be null or repeat, and two hashes of its text.
    """
    need = cut(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct().join(reps, "node"))
    few = need.count() <= BROADCAST_ROWS
    need = need.select("node", F.col("rep.doc_id").alias("id_"), F.col("rep.key").alias("key_"), F.col("rep.key2").alias("key2_"))
    return source.join(F.broadcast(need) if few else need, F.col("doc_id").eqNullSafe(F.col("id_")) & (F.col("key") == F.col("key_")) & (F.col("key2") == F.col("key2_"))).select("node", "text")


def _both(pairs: DataFrame, of: DataFrame, value: str) -> DataFrame:
    for side in ("b", "a"):
        pairs = pairs.join(of.select(F.col("node").alias(side), F.col(value).alias(f"{value}_{side}")), side)
    return pairs


def _links(pairs: DataFrame, source: DataFrame, reps: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs of nodes (a, b) that link. Pairs must meet under the orders by hash; of those that do, one text of each node is moved."""
    pairs = cut(pairs)
    orders = cut(_texts(pairs, source, reps).mapInArrow(_hash_orders(width, percent), "node long, prefixes binary").dropDuplicates(["node"]))
    pairs = cut(_both(pairs, orders, "prefixes").mapInArrow(_meet, "a long, b long"))
    texts = cut(_texts(pairs, source, reps).dropDuplicates(["node"]))
    return cut(_both(pairs, texts, "text").mapInArrow(_verify(width, percent), "a long, b long"))


def _components(docs: DataFrame, id_col: str, text: str, width: int, percent: int) -> DataFrame:
    """(doc_id, key, key2, n, least) of every row: least is the row (no_id, doc_id, key, key2) that comes first in its component."""
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(docs, text).alias("text")).select("*", F.xxhash64("text").alias("key"), F.xxhash64(F.lit(1), "text").alias("key2"))
    owners = min(4096, tasks_for(spark))
    shape = "kind int, doc_id long, key long, key2 long, n long, node long, check long, bits binary, owner int, token binary, count binary"
    own = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key", "key2")
    for seed in range(SEEDS):
        described = cut(source.mapInArrow(_describe(width, owners, seed), shape))
        info = described.where("kind = 0 and n > 0").groupBy("node").agg(F.min(own).alias("rep"), F.first("n").alias("n"), F.first("bits").alias("bits"), F.min("check").alias("low"), F.max("check").alias("high"))
        info = cut(info)
        if info.where("low <> high").isEmpty():
            break
    else:
        raise RuntimeError("the sets of documents could not be told apart by their hashes")
    info = info.drop("low", "high")
    nodes = described.where("kind = 0").select("doc_id", "key", "key2", "n", "node")
    shared = spark.sparkContext.broadcast(_frequent(described))
    total = nodes.agg(F.sum(F.col("n") * (100 - percent) / 100 + 1)).first()[0] or 0
    buckets = int(min(1 << 19, max(tasks_for(spark), total // BUCKET_POSTINGS + 1)))
    postings = source.select("text").mapInArrow(_postings(shared, width, percent, buckets, seed), "bucket int, token binary, node binary, size binary")
    groups = postings.groupBy("bucket").applyInPandas(_groups, "sizes binary, node binary, size binary")
    groups = cut(groups.withColumn("row", F.monotonically_increasing_id()))
    reps = info.select("node", "rep")
    gap = _gap(percent)
    owners, packed = int(info.count() // OWNER_NODES + 1), "owner int, a binary, b binary"
    stars = _distinct_pairs(_attach(groups, _degrees(groups, owners), "degree", owners).mapInArrow(_star(gap, owners), packed))
    edges = _links(_likely(stars, info, percent), source, reps, width, percent)
    comps = cut(connected_components(edges, "a", "b"))
    mixed = cut(_attach(groups, comps, "component", owners).mapInArrow(_mixed(gap), "row long, sizes binary, node binary, size binary, comp binary"))
    crossed = _distinct_pairs(_attach(mixed, info, "n", owners).mapInArrow(_cross(gap, percent, owners), packed))
    more = _links(crossed, source, reps, width, percent)
    if not more.isEmpty():
        comps = cut(connected_components(edges.union(more), "a", "b"))
    least = reps.join(comps, "node").groupBy("component").agg(F.min("rep").alias("least"))
    by_node = comps.join(least, "component").select("node", "least")
    alone = reps.join(comps, "node", "left_anti").select("node", F.col("rep").alias("least"))
    named = cut(by_node.union(alone))
    return nodes.join(named, "node", "left").select("doc_id", "key", "key2", "n", F.when(F.col("n") > 0, F.col("least")).otherwise(own).alias("least"))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id.

    A-Z are lower-cased; words are runs of characters other than space and \\x09-\\x0D. A text
    with fewer words than width, but some, is one shingle; one without words (or null) has none,
    links with nothing and is its own component. Linked: 100 * intersection >= percent * union.
    component_id is the smallest id reachable. Repeated rows repeat; an empty table gives none.
    Ids are expected to be integers; null and repeated ids name documents of their own, by their
    texts. A component whose ids are all null has a null component_id.
    """
    return _components(docs, id_col, text, width, percent).select("doc_id", F.col("n").alias("n_shingles"), F.col("least.doc_id").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """The rows of docs, all columns, without near copies: of each component the row of smallest id stays (null ids last).

    Rows that share an id are told apart by their texts; of such rows in one component one text
    stays. Rows of one id and one text stay or go together. Texts without words stay.
    """
    names = spare(docs, "__id", "__key", "__key2")
    found = _components(docs, id_col, text, width, percent)
    own = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key", "key2")
    gone = cut(found.where(~own.eqNullSafe(F.col("least"))).select(*[F.col(c).alias(n) for c, n in zip(("doc_id", "key", "key2"), names)]).distinct())
    few = gone.count() <= BROADCAST_ROWS
    mine = whole_text(docs, text)
    same = F.col(id_col).cast("long").eqNullSafe(F.col(names[0])) & (F.xxhash64(mine) == F.col(names[1])) & (F.xxhash64(F.lit(1), mine) == F.col(names[2]))
    return docs.join(F.broadcast(gone) if few else gone, same, "left_anti")


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
s AS (
  SELECT r, doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
         ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS sh FROM w),
x AS (SELECT r, len(sh) AS n, unnest(sh) AS k FROM s),
p AS (SELECT a.r AS a, b.r AS b, count(*) AS c, any_value(a.n) AS na, any_value(b.n) AS nb FROM x a JOIN x b ON a.k = b.k AND a.r < b.r GROUP BY 1, 2),
l AS (SELECT a, b FROM p WHERE 100 * c >= 80 * (na + nb - c)),
edges AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach AS (SELECT r AS a, r AS b FROM s UNION SELECT reach.a, edges.b FROM reach JOIN edges ON reach.b = edges.a)
SELECT s.doc_id, CAST(any_value(len(s.sh)) AS BIGINT) AS n_shingles, min(t.doc_id) AS component_id
FROM s JOIN reach ON s.r = reach.a JOIN s t ON t.r = reach.b GROUP BY s.r, s.doc_id
"""


def query(spark, sf_dir):
    """op10: all documents."""
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
