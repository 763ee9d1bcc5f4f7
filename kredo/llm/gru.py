"""A small gated recurrent language model in numpy with a class-factored output."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

HIDDEN = 16
STEPS = 20               # of a training window: gradients stop at its start
LANES = 64               # documents that are read side by side in training
SCORE_STEPS = 32         # of a scoring window
SIDE_BY_SIDE = 1 << 10   # documents that go forward together in scoring: their states stay in the cache
OUTPUTS = 1 << 11        # and tokens whose outputs are worked out together
RATE = 0.3
CLIP = 5.0


@lru_cache(maxsize=1)
def one_thread() -> None:
    """Let matrix products run on the calling thread alone.  A task has one core, and on
    matrices as small as these the threads of OpenBLAS would spend more time waiting for
    each other than computing.  Other libraries are left as they are."""
    import ctypes

    try:
        with open("/proc/self/maps", encoding="utf-8") as f:
            paths = {line.split()[-1] for line in f if "openblas" in line}
    except OSError:
        return
    for path in paths:
        library = ctypes.CDLL(path)
        for name in ("openblas_set_num_threads", "openblas_set_num_threads64_",
                     "scipy_openblas_set_num_threads", "scipy_openblas_set_num_threads64_"):
            if hasattr(library, name):
                getattr(library, name)(1)


@lru_cache(maxsize=1)
def keep_memory() -> None:
    """Let the allocator keep up to 64 MB that numpy gives back.  Otherwise each window's
    arrays go back to the system and are mapped, page by page, for the next one: where
    measured, an eighth to a quarter of a window's time.  Where the C library has no such setting nothing changes."""
    import ctypes

    try:
        mallopt = ctypes.CDLL(None).mallopt
    except (OSError, AttributeError):
        return
    mallopt(-3, 32 << 20)         # M_MMAP_THRESHOLD
    mallopt(-1, 64 << 20)         # M_TRIM_THRESHOLD


@dataclass(frozen=True)
class Layout:
    """Outputs: ``classes`` classes of ``size`` head words each, then ``bins`` bins of
    all other words, of which the model gives the bin alone.  A token is its head
    place, or the number of head places plus its bin."""
    classes: int
    size: int
    bins: int

    @property
    def head(self) -> int:
        return self.classes * self.size

    @property
    def inputs(self) -> int:
        return self.head + self.bins

    def class_of(self, token: np.ndarray) -> np.ndarray:
        return np.where(token < self.head, token // self.size, token - self.head + self.classes)


def initial(layout: Layout, weight: np.ndarray, hidden: int = HIDDEN) -> dict[str, np.ndarray]:
    """Parameters that start at the class and word shares of ``weight``, the count of
    each token."""
    rng = np.random.default_rng(42)
    small = lambda *shape: (rng.standard_normal(shape) * 0.1).astype(np.float32)
    w = weight.astype(float) + 0.01
    words = w[:layout.head].reshape(layout.classes, layout.size)
    shares = np.concatenate([words.sum(axis=1), w[layout.head:]])
    return {"in": small(layout.inputs, 3 * hidden), "u": small(hidden, 3 * hidden),
            "cw": small(hidden, layout.classes + layout.bins) * 0.1,
            "cb": np.log(shares / shares.sum()).astype(np.float32),
            "ww": small(layout.classes, hidden, layout.size) * 0.1,
            "wb": np.log(words / words.sum(axis=1, keepdims=True)).astype(np.float32)}


_ONE, _LIMIT = np.array(1, np.float32), np.array(30, np.float32)


def _gates_negated(x, hidden: int):
    """``x``, rows of gates and candidate, with the gates' rows negated: the logistic function
    needs them so, and a sign costs nothing here."""
    np.negative(x[:2 * hidden], out=x[:2 * hidden])
    return x


def _step(gates, candidate, g, h, rz, r, z, c, out):
    """Write the state after ``h`` to ``out``, a column for each lane, from the input's gates
    (negated) and candidate and ``g``, the products of ``h``; the gates and the candidate are
    left in ``rz``, whose parts are ``r`` and ``z``, and ``c``, which the way back needs.

    On arrays this small a call costs more than its arithmetic: nothing is sliced or
    allocated here, and every array is whole."""
    n = len(gates)
    np.add(gates, g[:n], rz)
    np.minimum(rz, _LIMIT, rz)
    np.exp(rz, rz)
    np.add(rz, _ONE, rz)
    np.reciprocal(rz, rz)
    np.multiply(r, g[n:], c)
    np.add(c, candidate, c)
    np.tanh(c, c)
    np.subtract(h, c, out)
    np.multiply(out, z, out)
    np.add(out, c, out)


def _sums(x):
    """The sum of each column: eight partial sums and then those by pairs, the order in
    which numpy adds up a row."""
    if len(x) % 8:
        return x.sum(axis=0)
    x = np.add.reduce(x.reshape(len(x) // 8, 8, x.shape[1]), axis=0)
    while len(x) > 1:
        x = x[::2] + x[1::2]
    return x[0]


def _softmax(x):
    """The softmax of each column, in the place of ``x``."""
    x -= x.max(axis=0)
    np.exp(x, out=x)
    x /= _sums(x)
    return x


def _log_softmax_at(x, place):
    """Natural log of each column's softmax at its place; ``x`` is used up."""
    x -= x.max(axis=0)
    at = x[place, np.arange(x.shape[1])]
    np.exp(x, out=x)
    return at - np.log(_sums(x))


def _order(of, below: int):
    """Places by value, equal ones as they come; short integers are sorted by radix."""
    return np.argsort(of.astype(np.uint16) if below <= 1 << 16 else of, kind="stable")


def _row_sums(x, begins):
    """The sum of the rows from each place of ``begins`` to the next.  Most have one row
    or two, which take no reduction."""
    n = np.diff(begins, append=len(x))
    out = x.take(begins, axis=0)
    two, more = np.flatnonzero(n == 2), np.flatnonzero(n > 2)
    out[two] += x.take(begins[two] + 1, axis=0)
    if len(more):
        n, ends = n[more], np.cumsum(n[more])
        rows = np.arange(ends[-1]) + np.repeat(begins[more] - ends + n, n)
        out[more] = np.add.reduceat(x.take(rows, axis=0), ends - n, axis=0)
    return out


def _by_class(layout: Layout, target):
    """Places of the head targets by class, and (class, its part of them)."""
    order = _order(target, layout.inputs)
    cut = np.searchsorted(target[order], np.arange(layout.classes + 1) * layout.size).tolist()
    return order[:cut[-1]], [(k, slice(cut[k], cut[k + 1])) for k in range(layout.classes) if cut[k] < cut[k + 1]]


def _with_bias(weights, bias):
    """Weights with the bias as one more input, which is always 1."""
    return np.concatenate([weights, bias[..., None, :]], axis=-2)


def _inner(weights, layout: Layout, h, parts):
    """Logits of the words in each state's class, for states by class; a column for each."""
    x = np.empty((layout.size, h.shape[1]), np.result_type(h, weights))
    for k, part in parts:
        np.matmul(weights[k].T, h[:, part], x[:, part])
    return x


def log_probs(weights, layout: Layout, h: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Natural log of class times word in class for each target after the state in its
    column of ``h``, whose last row is 1; ``weights``: of classes and words, with biases."""
    of_class, of_word = weights
    out = _log_softmax_at(of_class.T @ h, layout.class_of(target))
    order, parts = _by_class(layout, target)
    out[order] += _log_softmax_at(_inner(of_word, layout, h.take(order, axis=1), parts), target[order] % layout.size)
    return out


def score(p, layout: Layout, docs: list[np.ndarray]) -> np.ndarray:
    """Natural log-likelihood of each document (tokens with the end as last).

    Documents of like length go forward together, longest first, so that at each step the
    ones that go on are the first rows.  The state goes on from window to window, so
    nothing of a document is left out; outputs are worked out a window at a time."""
    out = np.zeros(len(docs))
    order = np.argsort(-np.array([len(d) for d in docs], np.int64), kind="stable")
    for low in range(0, len(docs), SIDE_BY_SIDE):
        part = order[low:low + SIDE_BY_SIDE]
        out[part] = _forward(p, layout, [docs[i] for i in part])
    return out


def _forward(p, layout: Layout, docs: list[np.ndarray]) -> np.ndarray:
    """``score`` of documents that are ordered by length, longest first."""
    lengths = np.array([len(d) for d in docs])
    total = np.zeros(len(docs))
    first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    tokens = np.concatenate(docs)
    hidden = p["u"].shape[0]
    inputs, u = _gates_negated(p["in"].T.copy(), hidden).T.copy(), _gates_negated(p["u"].T.copy(), hidden)
    weights = _with_bias(p["cw"], p["cb"]), _with_bias(p["ww"], p["wb"])
    h = np.zeros((hidden, len(docs)), np.float32)
    last = np.zeros(len(docs), np.int64)          # the end token stands for a start
    for begin in range(0, int(lengths[0]), SCORE_STEPS):
        ends = np.arange(begin, min(begin + SCORE_STEPS, int(lengths[0])))
        live = np.searchsorted(-lengths, -ends, "left").tolist()      # documents of more than t tokens
        ends = np.cumsum(live).tolist()
        states, targets = np.ones((hidden + 1, ends[-1]), np.float32), np.empty(ends[-1], np.int64)
        for t, n, end in zip(range(begin, begin + len(live)), live, ends):
            if n < h.shape[1]:
                h = h[:, :n].copy()
            if t == begin or n < rz.shape[1]:
                rz, c = np.empty((2 * hidden, n), np.float32), np.empty((hidden, n), np.float32)
            x = inputs.take(last[:n], axis=0).T.copy()
            after = np.empty((hidden, n), np.float32)
            _step(x[:2 * hidden], x[2 * hidden:], u @ h, h, rz, rz[:hidden], rz[hidden:], c, after)
            h = states[:-1, end - n:end] = after
            last = targets[end - n:end] = tokens[first[:n] + t]
        rows = np.concatenate([np.arange(n) for n in live])
        for low in range(0, len(targets), OUTPUTS):
            part = slice(low, low + OUTPUTS)
            total += np.bincount(rows[part], log_probs(weights, layout, states[:, part], targets[part]).astype(float), len(docs))
    return total


class Trainer:
    """Adagrad on windows of STEPS tokens; the state is carried from one to the next,
    gradients are not."""

    def __init__(self, p, layout: Layout):
        self.p = {k: v.copy() for k, v in p.items()}
        self.layout = layout
        self.square = {k: np.full(v.shape, 0.1, np.float32) for k, v in p.items()}

    def train(self, docs: Iterable[np.ndarray], lanes: int = LANES) -> int:
        """One pass over documents (tokens with the end as last); returns their tokens.

        ``lanes`` documents are read side by side.  Where one ends, the next one of the
        stream follows in its lane, from a fresh state, so that every step has work for
        all lanes until the stream is over, whatever the documents' lengths; only the
        documents in the lanes are held."""
        stream, total = iter(docs), 0
        now: list = [np.zeros(0, np.int64)] * lanes       # what is left of each lane's document
        last = np.zeros(lanes, np.int64)                  # the token before; the end stands for a start
        h = np.zeros((lanes, self.p["u"].shape[0]), np.float32)
        more = True
        while True:
            fresh = np.zeros((lanes, STEPS), bool)
            parts, filled = [], []
            for i, rest in enumerate(now):
                have = len(rest)
                if have >= STEPS:
                    parts.append(rest[:STEPS])
                    now[i] = rest[STEPS:]
                    filled.append(STEPS)
                    continue
                row = [rest]
                while have < STEPS and more:
                    doc = next(stream, None)
                    if doc is None:
                        more = False
                    elif len(doc):
                        fresh[i, have] = True
                        row.append(doc[:STEPS - have])
                        rest = doc[STEPS - have:]
                        have += len(row[-1])
                now[i] = rest if have == STEPS and len(row) > 1 else rest[:0]
                filled.append(have)
                parts += row
                if have < STEPS:
                    parts.append(np.zeros(STEPS - have, np.int64))
            if not any(filled):
                return total
            target = np.concatenate(parts).reshape(lanes, STEPS)
            filled = np.array(filled)
            total += int(filled.sum())
            order = np.argsort(-filled, kind="stable")
            order = order[filled[order] > 0]
            inside = np.arange(int(filled.max()))[:, None] < filled[order]
            live = inside.sum(axis=1).tolist()
            target, fresh = target[order], fresh[order]
            token = np.concatenate([last[order][:, None], target[:, :-1]], axis=1)
            token[fresh] = 0
            flat = [x.T[:len(live)][inside] for x in (token, target, fresh)]
            state = self._window(flat[0], flat[1], live, h[order], flat[2])
            last[order] = target[np.arange(len(order)), filled[order] - 1]
            h[order] = state

    def gradients(self, token, target, live, h, fresh=None) -> tuple[dict, np.ndarray, np.ndarray]:
        """Gradients of the window's loss (``in`` aside), those of the input rows of its
        tokens, and the state after it.  ``token`` and ``target`` are its steps one after
        the other; step t has the first ``live[t]`` lanes.  Where ``fresh`` is set, a
        document begins: its state is zero and no gradient goes back beyond.

        A step's arrays have a column for each of the first step's lanes; what a lane that is
        over has there reaches no gradient."""
        p, n, steps, wide = self.p, h.shape[1], len(live), live[0]
        at = None if live[-1] == wide else np.flatnonzero(np.arange(wide) < np.array(live)[:, None])
        begins: dict = {}
        if fresh is not None and fresh.any():
            for i in (np.flatnonzero(fresh) if at is None else at[fresh]).tolist():
                begins.setdefault(i // wide, []).append(i % wide)

        def spread(rows):                         # (tokens, k) to (steps, k, lanes)
            if at is not None:
                rows_, rows = rows, np.zeros((steps * wide, rows.shape[1]), rows.dtype)
                rows[at] = rows_
            return rows.reshape(steps, wide, -1).transpose(0, 2, 1)

        def rows_of(x):                           # and back
            x = x.transpose(0, 2, 1).reshape(steps * wide, -1)
            return x if at is None else x.take(at, axis=0)

        def times(t, x, weights, to):             # one lane alone is a product of a vector
            if live[t] == 1:
                x, to = x[:, :1], to[:, :1]
            np.matmul(x.T, weights, to.T)

        empty = lambda *shape: np.empty((steps, *shape, wide), np.float32)
        inputs = empty(3 * n)
        inputs[:] = spread(p["in"].take(token, axis=0))
        np.negative(inputs[:, :2 * n], out=inputs[:, :2 * n])
        u, u_back = _gates_negated(p["u"].T.copy(), n).T.copy(), p["u"].T.copy()
        states, rz, c, g = np.empty((steps + 1, n, wide), np.float32), empty(2 * n), empty(n), empty(3 * n)
        g[:] = 0
        states[0] = h.T
        r, z = rz[:, :n], rz[:, n:]
        state = states[0]
        for t, (gates, candidate, g_, rz_, r_, z_, c_, after) in enumerate(zip(
                inputs[:, :2 * n], inputs[:, 2 * n:], g, rz, r, z, c, states[1:])):
            if t in begins:
                state = state.copy()
                state[:, begins[t]] = 0
            times(t, state, u, g_)
            _step(gates, candidate, g_, state, rz_, r_, z_, c_, after)
            state = after
        before = states[:-1]
        if begins:
            before = before.copy()
            for t, lanes in begins.items():
                before[t][:, lanes] = 0
        # outputs: a column for each token, and a row where tokens are added up
        out_rows = rows_of(states[1:])
        out = np.ones((n + 1, len(token)), np.float32)
        out[:-1] = out_rows.T
        d = _with_bias(p["cw"], p["cb"]).T @ out
        _softmax(d)
        d[self.layout.class_of(target), np.arange(len(target))] -= 1
        d = d.T.copy()
        grad = {k: np.zeros_like(v) for k, v in p.items() if k in ("ww", "wb")}
        grad["cw"], grad["cb"] = out_rows.T @ d, d.sum(axis=0)
        dh_all = d @ p["cw"].T
        order, parts = _by_class(self.layout, target)
        here = out.take(order, axis=1)
        d = _inner(_with_bias(p["ww"], p["wb"]), self.layout, here, parts)
        _softmax(d)
        d[target[order] % self.layout.size, np.arange(len(order))] -= 1
        d, here, back = d.T.copy(), out_rows.take(order, axis=0), np.empty((len(order), n), dh_all.dtype)
        for k, part in parts:
            d_ = d[part]
            np.matmul(here[part].T, d_, grad["ww"][k])
            np.add.reduce(d_, 0, None, grad["wb"][k])
            np.matmul(d_, p["ww"][k].T, back[part])
        dh_all[order] += back
        dh_all = spread(dh_all)
        # what each gate passes back, for all steps at once: from the state to the update gate,
        # the candidate and the state before, and from the candidate to the reset gate and ``g``
        of_state, of_c = empty(3, n), empty(2, n)
        rest, x = 1 - z, 1 - c * c
        np.multiply(rest, x, of_state[:, 1])
        np.subtract(before, c, x)
        x *= z
        np.multiply(x, rest, of_state[:, 0])
        of_state[:, 2] = z
        np.multiply(g[:, 2 * n:], r, x)
        np.subtract(1, r, rest)
        np.multiply(x, rest, of_c[:, 0])
        of_c[:, 1] = r
        # blocks 0 to 2: gradients of ``g``; 1, 3 and 5: those that come from the state
        change = empty(6, n)
        dg, dc = change[:, :3].reshape(steps, 3 * n, wide), change[:, 3]
        dh, back = np.empty((n, wide), np.float32), np.zeros((n, wide), np.float32)
        whole = list(zip(range(steps), dh_all, of_state, of_c, change[:, 1::2], dc, change[:, :3:2], dg, change[:, 5]))
        for t, from_out, of_state_, of_c_, from_state, dc_, from_c, dg_, kept in reversed(whole):
            np.add(from_out, back, dh)
            np.multiply(dh, of_state_, from_state)
            np.multiply(dc_, of_c_, from_c)
            times(t, dg_, u_back, back)
            np.add(kept, back, back)
            if t in begins:
                back[:, begins[t]] = 0
        change = rows_of(dg)
        grad["u"] = rows_of(before).T @ change
        change[:, 2 * n:] = rows_of(dc)
        h = states[-1].T
        if at is not None:
            length = (np.array(live)[:, None] > np.arange(wide)).sum(axis=0)
            h = states[length, :, np.arange(wide)]
        return grad, change, h

    def _window(self, token, target, live, h, fresh):
        grad, change, h = self.gradients(token, target, live, h, fresh)
        scale = 1.0 / live[0]
        norm = np.sqrt(sum(float((grad[k] * grad[k]).sum()) for k in ("ww", "wb", "cw", "cb", "u"))) * scale
        scale *= min(1.0, CLIP / max(norm, 1e-9))
        # a class without a target has no gradient
        seen = np.flatnonzero(np.bincount(target // self.layout.size, minlength=self.layout.classes)[:self.layout.classes])
        seen = slice(None) if 2 * len(seen) > self.layout.classes else seen
        for k, g in grad.items():
            at = seen if k in ("ww", "wb") else slice(None)
            self._move(k, at, g[at] * scale)
        order = _order(token, self.layout.inputs)
        token = token[order]
        begins = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
        self._move("in", token[begins], _row_sums(change.take(order, axis=0), begins) * scale)
        return h

    def _move(self, k, at, g):
        """An Adagrad step of the parameters ``at``; ``g`` is used up."""
        square, x = self.square[k][at], g * g
        square += x
        if not isinstance(at, slice):
            self.square[k][at] = square
        g *= RATE
        np.sqrt(square, out=x)
        g /= x
        self.p[k][at] -= g
