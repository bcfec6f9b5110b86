"""Exact forward-backward over many sequences at once, for linear chains of K states.

Sequences are cut into segments of L positions. All segments advance together: arrays lie
step by step (the first positions of all segments, then the second ones, ...), so each step
works on one run of memory. Where a sequence has several segments, their K x K transfer
matrices and a scan over them give every segment its incoming and outgoing vectors; a
sequence of any length takes L vector steps and a scan of its length / L. A sequence of more
than MOST positions is walked in stretches, so what is held does not grow with it.
"""

from __future__ import annotations

import numpy as np

from glossa.llm.common import ragged

L = 512
#: Positions held at a time, with four vectors each.
MOST = 400_000
_TINY = 1e-30


class Plan:
    """Where the positions of sequences lie, step by step; segments that run longest first."""

    def __init__(self, before: np.ndarray):
        length = np.diff(before)
        self.parts = -(-length // L)
        doc, nth = ragged(self.parts)
        at = before[:-1][doc] + nth * L
        size = np.minimum(L, before[1:][doc] - at)
        order = np.argsort(-size, kind="stable")
        self.doc, self.nth, self.size, at = doc[order], nth[order], size[order], at[order]
        self.sequences = len(length)
        where = np.empty(len(order), np.int64)
        where[order] = np.arange(len(order))
        self.where, self.first_of = where, np.cumsum(self.parts) - self.parts
        steps = int(self.size[0]) if len(order) else 0
        self.active = np.searchsorted(-self.size, -np.arange(1, steps + 1), side="right")
        self.off = np.concatenate([[0], np.cumsum(self.active)])
        step, segment = ragged(self.active)
        self.segment = segment
        self.position = at[segment] + step  # of each place
        self.first = self.nth == 0
        self.last = self.off[self.size - 1] + np.arange(len(order))  # the place of each segment's last position
        self.long = np.flatnonzero(self.parts[self.doc] > 1)

    def scan(self) -> np.ndarray:
        """Sequences of several segments, those of most first."""
        longs = np.flatnonzero(self.parts > 1)
        return longs[np.argsort(-self.parts[longs], kind="stable")]


def _transfer(p: Plan, e: np.ndarray, trans: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The scaled transfer matrices of the segments p.long."""
    k = len(e)
    m, to = np.empty((k, k, len(p.long)), e.dtype), np.ascontiguousarray(trans.T)
    for t in range(len(p.active)):
        live = int(np.searchsorted(p.long, p.active[t]))
        if not live:
            break
        now, x = e[:, p.off[t] + p.long[:live]], m[:, :, :live]
        if t:
            np.multiply(np.matmul(to, x), now, out=x)
        else:
            np.multiply(np.where(p.first[p.long[:live]], start.astype(e.dtype)[None, :, None], trans[:, :, None]), now, out=x)
        if t % 2:
            x /= np.maximum(x.max((0, 1)), _TINY)
    return np.ascontiguousarray((m / np.maximum(m.max((0, 1)), _TINY)).transpose(2, 0, 1))


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(v.sum(-1, keepdims=True), _TINY)


def _enter(p: Plan, m: np.ndarray, k: int, trans: np.ndarray, start: np.ndarray, dtype) -> np.ndarray:
    """The weights of the states at each segment's first position, before its emission."""
    enter = np.broadcast_to(start.astype(dtype), (len(p.doc), k)).copy()
    if len(p.long):
        index = np.full(len(p.doc), -1)
        index[p.long] = np.arange(len(p.long))
        longs = p.scan()
        v = np.full((len(longs), k), 1.0 / k, dtype)
        for s in range(int(p.parts[longs[0]]) - 1):
            on = np.searchsorted(-p.parts[longs], -(s + 1), side="left")
            v[:on] = _unit(np.einsum("ni,nij->nj", v[:on], m[index[p.where[p.first_of[longs[:on]] + s]]]))
            enter[p.where[p.first_of[longs[:on]] + s + 1]] = v[:on] @ trans
    return enter.T


def _leave(p: Plan, m: np.ndarray, k: int, stop: np.ndarray | None, dtype) -> np.ndarray:
    """How well the states at each segment's last position lead on, up to a factor."""
    leave = np.broadcast_to((np.ones(k) if stop is None else stop).astype(dtype), (len(p.doc), k)).copy()
    if len(p.long):
        index = np.full(len(p.doc), -1)
        index[p.long] = np.arange(len(p.long))
        longs = p.scan()
        w = leave[p.where[p.first_of[longs] + p.parts[longs] - 1]]
        for s in range(int(p.parts[longs[0]]) - 1, 0, -1):
            on = np.searchsorted(-p.parts[longs], -s, side="left")
            w[:on] = _unit(np.einsum("nij,nj->ni", m[index[p.where[p.first_of[longs[:on]] + s]]], w[:on]))
            leave[p.where[p.first_of[longs[:on]] + s - 1]] = w[:on]
    return leave.T


def _forward(p: Plan, e: np.ndarray, trans: np.ndarray, enter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward vectors, each of sum 1, and what each was divided by; by place."""
    alpha, scale, to = np.empty_like(e), np.empty(e.shape[1], e.dtype), np.ascontiguousarray(trans.T)
    last, off = None, p.off.tolist()
    for lo, hi in zip(off, off[1:]):
        x = alpha[:, lo:hi]
        if lo:
            np.matmul(to, last[:, : hi - lo], out=x)
            x *= e[:, lo:hi]
        else:
            np.multiply(enter, e[:, lo:hi], out=x)
        s = np.add.reduce(x, 0, out=scale[lo:hi])
        np.maximum(s, _TINY, out=s)
        x /= s
        last = x
    return alpha, scale


def _backward(p: Plan, e: np.ndarray, trans: np.ndarray, alpha: np.ndarray, scale: np.ndarray, leave: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Backward vectors, so that alpha * beta sums to 1, and the summed expectations of transitions; by place. e is overwritten."""
    k = len(e)
    beta, xi = np.empty_like(e), np.zeros((k, k))
    leave = leave / np.maximum((alpha[:, p.last] * leave).sum(0), _TINY)
    e /= scale
    off, inner = p.off.tolist(), 0
    for lo, hi in zip(off[-2::-1], off[:0:-1]):
        if inner:
            out = e[:, hi : hi + inner]
            out *= beta[:, hi : hi + inner]
            np.matmul(trans, out, out=beta[:, lo : lo + inner])
            xi += alpha[:, lo : lo + inner] @ out.T
        beta[:, lo + inner : hi] = leave[:, inner : hi - lo]
        inner = hi - lo
    later = np.flatnonzero(~p.first)
    if len(later):  # from a segment to the next; the first places are not overwritten yet
        out = e[:, later] * beta[:, later]
        prev = p.where[p.first_of[p.doc[later]] + p.nth[later] - 1]
        xi += alpha[:, p.last[prev]] @ out.T
    return beta, xi * trans


def _run(p: Plan, e: np.ndarray, trans: np.ndarray, start: np.ndarray, stop: np.ndarray | None = None, backward: bool = True):
    """(alpha, beta, xi, log-likelihoods); all by place, states first. e is overwritten."""
    k = len(e)
    trans = trans.astype(e.dtype)
    # the likeliest state of each position emits 1: a product over rare words alone would leave single precision
    peak = np.maximum(e.max(0), _TINY) if e.size else e[:1].ravel()
    e /= peak
    m = _transfer(p, e, trans, start) if len(p.long) else np.zeros((0, 0, 0), e.dtype)
    alpha, scale = _forward(p, e, trans, _enter(p, m, k, trans, start, e.dtype))
    lik = np.bincount(p.doc[p.segment], np.log(scale.astype(float) * peak), minlength=p.sequences) if e.size else np.zeros(p.sequences)
    if not backward:
        return alpha, None, None, lik
    beta, xi = _backward(p, e, trans, alpha, scale, _leave(p, m, k, stop, e.dtype))
    return alpha, beta, xi, lik


def posteriors(e: np.ndarray, before: np.ndarray, trans: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posteriors (N, K), summed transition expectations (K, K) and log-likelihoods.

    e: (N, K) positive emissions of all positions; before: positions before each sequence, one
    more than sequences; trans: (K, K) positive, start: (K). A sequence of no positions has
    log-likelihood 0.
    """
    p = Plan(before)
    alpha, beta, xi, lik = _run(p, np.ascontiguousarray(e[p.position].T), trans, start)
    gamma = np.empty_like(e)
    alpha *= beta
    gamma[p.position] = alpha.T
    return gamma, xi, lik


def stretches(before: np.ndarray) -> list[tuple[int, int]]:
    """Runs of whole sequences of about MOST positions, or one longer sequence."""
    out, a, last = [], 0, len(before) - 1
    while a < last:
        b = max(a + 1, int(np.searchsorted(before, before[a] + MOST, side="right")) - 1)
        out.append((a, b))
        a = b
    return out


def _emissions(states: np.ndarray, c: np.ndarray) -> np.ndarray:
    """(K, N) emissions of the classes c; states: (K, classes)."""
    out = np.empty((len(states), len(c)), states.dtype)
    for row, to in zip(states, out):
        np.take(row, c, out=to, mode="clip")
    return out


def expected_counts(emit: np.ndarray, cls: np.ndarray, before: np.ndarray, trans: np.ndarray, start: np.ndarray):
    """Expected starts (K), transitions (K, K) and emissions (classes, K), and the sum of log-likelihoods.

    emit: (classes, K); cls: the class of each position. Vectors are of emit's precision, sums of double precision.
    """
    k = len(start)
    starts, trans_sum, emitted, total = np.zeros(k), np.zeros((k, k)), np.zeros(emit.shape[::-1]), 0.0
    states = np.ascontiguousarray(emit.T)

    def add(c: np.ndarray, at: np.ndarray, first: np.ndarray, stop: np.ndarray | None, begins: bool) -> np.ndarray:
        nonlocal trans_sum, total
        p = Plan(at)
        by = c[p.position].astype(np.int64, copy=False)
        alpha, beta, xi, lik = _run(p, _emissions(states, by), trans, first, stop)
        trans_sum += xi
        total += float(lik.sum())
        head = emit[c[0]] / emit[c[0]].max() * beta[:, p.where[0]]  # of a sequence alone: how well its first states lead on
        gamma = np.multiply(alpha, beta, out=beta)
        if begins:
            starts[:] += gamma[:, : len(p.doc)][:, p.first].sum(1)
        for row, to in zip(gamma, emitted):
            to += np.bincount(by, row, minlength=len(emit))
        return head

    for a, b in stretches(before):
        lo, hi = int(before[a]), int(before[b])
        if hi - lo <= MOST:
            if hi > lo:
                add(cls[lo:hi], before[a : b + 1] - lo, start, None, True)
            continue
        cuts = [*range(lo, hi, MOST), hi]
        enters = [(start, None)]
        for x, y in zip(cuts[:-2], cuts[1:-1]):
            p = Plan(np.array([0, y - x]))
            alpha = _run(p, _emissions(states, cls[x:y][p.position]), trans, enters[-1][0], backward=False)[0]
            end = alpha[:, p.last[p.where[-1]]].astype(float)
            enters.append((end @ trans, end))
        stop = None
        for x, y, (first, end) in reversed(list(zip(cuts[:-1], cuts[1:], enters))):
            out = add(cls[x:y], np.array([0, y - x]), first, stop, end is None).astype(float)
            if end is not None:
                stop = trans @ out
                stop /= stop.sum()
                both = trans * np.outer(end, out)
                trans_sum += both / both.sum()
    return starts, trans_sum, emitted.T, total


def log_likelihoods(emit: np.ndarray, cls: np.ndarray, before: np.ndarray, trans: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Natural logarithms of the probabilities of the sequences."""
    out = np.zeros(len(before) - 1)
    states = np.ascontiguousarray(emit.T)
    for a, b in stretches(before):
        lo, hi = int(before[a]), int(before[b])
        if hi - lo <= MOST:
            p = Plan(before[a : b + 1] - lo)
            out[a:b] = _run(p, _emissions(states, cls[lo:hi][p.position]), trans, start, backward=False)[3]
            continue
        enter = start
        for x in range(lo, hi, MOST):
            y = min(x + MOST, hi)
            p = Plan(np.array([0, y - x]))
            alpha, _, _, lik = _run(p, _emissions(states, cls[x:y][p.position]), trans, enter, backward=False)
            out[a] += lik[0]
            enter = alpha[:, p.last[p.where[-1]]].astype(float) @ trans
    return out
