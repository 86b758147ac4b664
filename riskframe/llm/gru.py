"""A gated recurrent language model in numpy: truncated backpropagation, class-factored softmax.

Vocabulary: ``words`` explicit words, sorted into classes that are ranges of
word numbers, and after them one input symbol for each spelling class of all
other words. The output is P(class | state), times P(word | class, state) for
the explicit words; what a spelling class gives to its words is the caller's.

Documents run in lanes. A lane reads its documents one after the other; the
state is carried across windows and set to zero where a document begins.

Defined results: no documents give no score and no update; a document has its
end symbol at least; a document of any length is read in windows, and memory
grows with the symbols of the chunk.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np

WINDOW = 16
MAX_LANES = 512
MIN_UPDATES = 150
LOSS_EVERY = 1  # steps between losses in training: at 1 every token is a target


def keep_freed_memory() -> None:
    """Let the process reuse the memory of freed arrays instead of handing it back and asking again window by window.

    The allocator raises its thresholds to the size of a large block it has seen freed; the block itself is never
    touched. Without it over a quarter of the training was spent in page faults.
    """
    np.empty(31 << 20, dtype=np.uint8)


class Shape(NamedTuple):
    hidden: int
    bounds: np.ndarray  # of the explicit classes, as word numbers: len = classes + 1
    spelling: int

    @property
    def words(self) -> int:
        return int(self.bounds[-1])

    @property
    def classes(self) -> int:
        return len(self.bounds) - 1 + self.spelling


class Params(NamedTuple):
    x: np.ndarray   # (words + spelling, 3 * hidden) input of each symbol to update, reset and candidate
    u: np.ndarray   # (hidden, 3 * hidden)
    oc: np.ndarray  # (hidden, classes)
    bc: np.ndarray
    ow: np.ndarray  # (words, hidden)
    bw: np.ndarray

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self])


def shapes(s: Shape) -> list[tuple[int, ...]]:
    h = s.hidden
    return [(s.words + s.spelling, 3 * h), (h, 3 * h), (h, s.classes), (s.classes,), (s.words, h), (s.words,)]


def from_flat(s: Shape, flat: np.ndarray) -> Params:
    out, at = [], 0
    for shape in shapes(s):
        n = int(np.prod(shape))
        out.append(flat[at:at + n].reshape(shape).astype(np.float32))
        at += n
    return Params(*out)


def initial(s: Shape, class_counts: np.ndarray, word_counts: np.ndarray, seed: int) -> Params:
    """Small random weights; biases that give the unigram model."""
    rng = np.random.default_rng(seed)
    draw = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
    in_class = np.repeat(np.add.reduceat(word_counts, s.bounds[:-1]) if s.words else [], np.diff(s.bounds))
    return Params(draw(s.words + s.spelling, 3 * s.hidden), draw(s.hidden, 3 * s.hidden), draw(s.hidden, s.classes),
                  np.log((class_counts + 1) / (class_counts + 1).sum()).astype(np.float32), draw(s.words, s.hidden) * 0.5,
                  np.log((word_counts + 1) / (in_class + 1)).astype(np.float32))


def class_of(s: Shape, symbols: np.ndarray) -> np.ndarray:
    explicit = np.searchsorted(s.bounds, symbols, side="right") - 1
    return np.where(symbols < s.words, explicit, symbols - s.words + len(s.bounds) - 1)


class Lanes:
    """Documents (arrays of symbols, each ended by ``end``) in lanes, longest lane first.

    The symbols lie end to end, lane after lane; a window is cut out when it is due, so one very long
    document costs its own length and not that times the number of lanes.
    """

    def __init__(self, docs: list[np.ndarray], end: int, lanes: int) -> None:
        self.end = end
        order = sorted(range(len(docs)), key=lambda i: -len(docs[i]))
        lanes = max(1, min(lanes, len(docs)))
        load, mine = np.zeros(lanes, dtype=np.int64), [[] for _ in range(lanes)]
        for i in order:
            lane = int(np.argmin(load)) if len(docs) > lanes else len(mine) - int((load == 0).sum())
            mine[lane].append(i)
            load[lane] += len(docs[i])
        by = np.argsort(-load, kind="stable")
        self.load = load[by]
        self.start = np.cumsum(self.load) - self.load
        self.steps = int(self.load[0]) if len(docs) else 0
        laid = [i for lane in by for i in mine[lane]]
        size = np.array([len(docs[i]) for i in laid], dtype=np.int64)
        self.flat = np.concatenate([docs[i] for i in laid]) if len(laid) else np.zeros(0, dtype=np.int32)
        self.docs = np.repeat(np.array(laid, dtype=np.int32), size)
        self.first = np.zeros(len(self.flat), dtype=bool)
        self.first[(np.cumsum(size) - size)[size > 0]] = True

    def windows(self, window: int) -> Iterator[tuple[int, int, int]]:
        """(from, to, lanes still running)."""
        for a in range(0, self.steps, window):
            yield a, min(a + window, self.steps), int((self.load > a).sum())

    def cut(self, a: int, b: int, live: int) -> tuple[np.ndarray, ...]:
        """Steps × lanes of a window: inputs, targets, documents (-1 behind a lane's end) and where a document begins."""
        step = np.arange(a, b)[:, None]
        inside = step < self.load[:live]
        at = np.where(inside, step + self.start[:live], 0)
        fresh = inside & self.first[at]
        y, doc = np.where(inside, self.flat[at], self.end), np.where(inside, self.docs[at], -1)
        return np.where(inside & ~fresh, self.flat[at - 1], self.end), y, doc, fresh


def _run(p: Params, x: np.ndarray, fresh: np.ndarray, h: np.ndarray, trace: list | None) -> tuple[np.ndarray, np.ndarray]:
    """States after every step (steps, lanes, hidden) and the last one; ``trace`` takes what the way back needs of all steps."""
    k = p.u.shape[0]
    out = np.empty((*x.shape, k), dtype=np.float32)
    ones = np.float32(1)
    given = p.x[x]
    kept = [np.empty((*x.shape, k), dtype=p.u.dtype) for _ in range(5)] if trace is not None else None
    for t in range(len(x)):
        if fresh[t].any():
            h = h * ~fresh[t][:, None]
        a, u = given[t], h @ p.u
        g = a[:, :2 * k] + u[:, :2 * k]
        np.negative(g, out=g)
        np.exp(g, out=g)
        g += ones
        np.divide(ones, g, out=g)
        z, r = g[:, :k], g[:, k:]
        n = np.tanh(a[:, 2 * k:] + r * u[:, 2 * k:])
        if kept is not None:
            for store, value in zip(kept, (h, z, r, n, u[:, 2 * k:]), strict=True):
                store[t] = value
        h = n + z * (h - n)
        out[t] = h
    if kept is not None:
        trace.extend(kept)
    return out, h


def _with_one(states: np.ndarray) -> np.ndarray:
    """States with a last part of 1, which meets the bias in a product."""
    out = np.empty((len(states), states.shape[1] + 1), dtype=states.dtype)
    out[:, :-1] = states
    out[:, -1] = 1
    return out


def _softmax(logits: np.ndarray, safe: bool, scale: float = 1.0) -> np.ndarray:
    """``scale`` times the softmax of every row, in place."""
    if not safe:
        logits -= logits.max(axis=1, keepdims=True)
    np.exp(logits, out=logits)
    logits *= (scale / (logits @ np.ones(logits.shape[1], dtype=logits.dtype)))[:, None]
    return logits


#: exp() of a float32 stays finite up to here
SAFE = 80.0


def _safe(weights: np.ndarray, bias: np.ndarray, axis: int) -> bool:
    """Whether no state (its parts lie in [-1, 1]) can give a logit beyond SAFE."""
    return bool((np.abs(weights).sum(axis=axis) + np.abs(bias)).max(initial=0) < SAFE)


#: Logits computed at a time: a matrix that stays in the processor's cache.
CELLS = 1 << 17


def _log_picked(states: np.ndarray, weights: np.ndarray, pick: np.ndarray, safe: bool) -> np.ndarray:
    """Log softmax of ``states @ weights`` at one place of every row."""
    out = np.empty(len(pick), dtype=np.float64)
    kinds = weights.shape[1]
    at_once = max(1, CELLS // max(1, kinds))
    ones = np.ones(kinds, dtype=states.dtype)
    for i in range(0, len(pick), at_once):
        logits = states[i:i + at_once] @ weights
        if not safe:
            logits -= logits.max(axis=1, keepdims=True)
        own = logits[np.arange(len(logits)), pick[i:i + at_once]]
        np.exp(logits, out=logits)
        out[i:i + at_once] = own - np.log(logits @ ones)
    return out


def _order(numbers: np.ndarray, most: int) -> np.ndarray:
    """Stable order of numbers below ``most``; 16 bits sort by digits."""
    return np.argsort(numbers.astype(np.uint16) if most <= 1 << 16 else numbers, kind="stable")


def _by_class(classes: np.ndarray, explicit: int) -> Iterator[tuple[int, np.ndarray]]:
    order = _order(classes, int(classes.max(initial=0)) + 1)
    cuts = np.searchsorted(classes[order], np.arange(explicit + 1))
    for c in range(explicit):
        if cuts[c] < cuts[c + 1]:
            yield c, order[cuts[c]:cuts[c + 1]]


def score(p: Params, s: Shape, lanes: Lanes, n_docs: int, window: int = 8 * WINDOW) -> np.ndarray:
    """Natural log probability of every whole document, spelling classes counted as classes only."""
    keep_freed_memory()
    total = np.zeros(n_docs)
    h = np.zeros((len(lanes.load), s.hidden), dtype=np.float32)
    explicit = len(s.bounds) - 1
    safe, safe_inner = _safe(p.oc, p.bc, 0), _safe(p.ow, p.bw, 1)
    outer = np.vstack([p.oc, p.bc]).astype(np.float32)
    inner = [np.vstack([p.ow[lo:hi].T, p.bw[lo:hi]]).astype(np.float32) for lo, hi in zip(s.bounds[:-1], s.bounds[1:], strict=True)]
    for a, b, live in lanes.windows(window):
        h = h[:live]
        x, y, doc, fresh = lanes.cut(a, b, live)
        states, h = _run(p, x, fresh, h, None)
        there = doc >= 0
        states, y, doc = _with_one(states[there]), y[there], doc[there]
        c = class_of(s, y)
        lp = _log_picked(states, outer, c, safe)
        for k, rows in _by_class(c, explicit):
            lo, hi = s.bounds[k], s.bounds[k + 1]
            if hi - lo > 1:
                lp[rows] += _log_picked(states[rows], inner[k], y[rows] - lo, safe_inner)
        total += np.bincount(doc, weights=lp, minlength=n_docs)
    return total


class Trainer:
    """Adagrad over windows of truncated backpropagation."""

    def __init__(self, p: Params, s: Shape, rate: float, window: int = WINDOW, start: float = 1e-4) -> None:
        self.p, self.s, self.rate, self.window = Params(*[q.copy() for q in p]), s, rate, window
        self.sums = Params(*[np.full_like(q, start) for q in p])
        self.updates = self.tokens = 0
        keep_freed_memory()

    def _step(self, which: int, grad: np.ndarray, rows: np.ndarray | slice = slice(None)) -> None:
        acc, par = self.sums[which], self.p[which]
        acc[rows] += grad * grad
        par[rows] -= self.rate * grad / np.sqrt(acc[rows])

    def fit(self, docs: list[np.ndarray], end: int) -> None:
        # whole documents, as in scoring: a word at a window's seam follows its own state and previous word
        tokens = sum(map(len, docs))
        self.tokens += tokens
        lanes = Lanes(docs, end, max(8, min(MAX_LANES, tokens // (self.window * MIN_UPDATES))))
        h = np.zeros((len(lanes.load), self.s.hidden), dtype=np.float32)
        for a, b, live in lanes.windows(self.window):
            h = self._window(lanes, a, b, live, h[:live], usual=len(lanes.load) * (b - a))

    def _window(self, lanes: Lanes, a: int, b: int, live: int, h: np.ndarray, usual: int = 0) -> np.ndarray:
        """One update; a window of fewer than ``usual`` tokens (only the longest documents still run) weighs by its tokens."""
        p, s, k = self.p, self.s, self.s.hidden
        x, y, doc, fresh = lanes.cut(a, b, live)
        trace: list = []
        states, last = _run(p, x, fresh, h, trace)
        there = doc >= 0
        if LOSS_EVERY > 1:
            there[np.arange(b - a) % LOSS_EVERY != self.updates % LOSS_EVERY] = False
        if not there.any():
            return last
        whole = bool(there.all())  # no lane ends in the window: nothing to pick
        flat, y = (_with_one(states.reshape(-1, k)), y.ravel()) if whole else (_with_one(states[there]), y[there])
        scale = np.float32(1 / max(len(y), usual))
        c = class_of(s, y)
        outer, safe, turned = np.vstack([p.oc, p.bc]), _safe(p.oc, p.bc, 0), p.oc.T
        d, back = np.empty((len(y), s.classes), dtype=flat.dtype), np.empty((len(y), k), dtype=flat.dtype)
        at_once = max(1, CELLS // s.classes)
        for i in range(0, len(y), at_once):  # logits that stay in the processor's cache
            own = np.matmul(flat[i:i + at_once], outer, out=d[i:i + at_once])
            _softmax(own, safe, scale)
            own[np.arange(len(own)), c[i:i + at_once]] -= scale
            np.matmul(own, turned, out=back[i:i + at_once])
        grad_out = flat.T @ d
        safe_inner = _safe(p.ow, p.bw, 1)
        for j, rows in _by_class(c, len(s.bounds) - 1):
            lo, hi = int(s.bounds[j]), int(s.bounds[j + 1])
            if hi - lo > 1:
                part = flat[rows]
                e = _softmax(part @ np.vstack([p.ow[lo:hi].T, p.bw[lo:hi]]), safe_inner, scale)
                e[np.arange(len(rows)), y[rows] - lo] -= scale
                back[rows] += e @ p.ow[lo:hi]
                here, grad = slice(lo, hi), e.T @ part
                self._step(4, grad[:, :-1], here)
                self._step(5, grad[:, -1], here)
        if whole:
            d_states = back.reshape(states.shape)
        else:
            d_states = np.zeros_like(states)
            d_states[there] = back
        before, z, r, n, un = trace
        to_z, to_n, to_r = (before - n) * z * (1 - z), (1 - z) * (1 - n * n), un * r * (1 - r)
        grad_x = np.empty((*x.shape, 3 * k), dtype=np.float32)
        into = np.empty_like(grad_x)
        dh = np.zeros((live, k), dtype=np.float32)
        for t in range(b - a - 1, -1, -1):
            dh = dh + d_states[t]
            dn = dh * to_n[t]
            own = grad_x[t]
            own[:, :k] = dh * to_z[t]
            own[:, k:2 * k] = dn * to_r[t]
            own[:, 2 * k:] = dn
            into[t] = own
            into[t, :, 2 * k:] *= r[t]
            dh = dh * z[t] + into[t] @ p.u.T
            if fresh[t].any():
                dh[fresh[t]] = 0
        grad_u = before.reshape(-1, k).T @ into.reshape(-1, 3 * k)
        self._step(1, grad_u)
        self._step(2, grad_out[:-1])
        self._step(3, grad_out[-1])
        ids, rows = x.ravel(), grad_x.reshape(-1, 3 * k)
        order = _order(ids, s.words + s.spelling)
        ids = ids[order]
        first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
        self._step(0, np.add.reduceat(rows[order], first, axis=0), ids[first])
        self.updates += 1
        return last
