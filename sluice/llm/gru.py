"""A gated recurrent language model in numpy: truncated backpropagation, class-factored softmax.

Symbols are numbered so that those of a class stand together. The probability of a symbol is that
of its class times that within its class. Lanes run side by side through streams of documents; a
document starts from a zero state and the end symbol, and its state is carried from window to
window until its own end symbol, so whole documents are scored; in training the gradient stops at
the window's start and the state does not.
"""

from __future__ import annotations

import numpy as np

LANES_TRAIN, LANES_LEAST, WINDOW_TRAIN, WINDOWS_TRAIN = 256, 4, 32, 64
LANES_SCORE, WINDOW_SCORE = 512, 64
RATE, CLIP = 0.25, 1.0
#: The least probability of a step, where float32 would give none.
TINY = 1e-37


def init(counts: np.ndarray, bounds: np.ndarray, hidden: int, seed: int) -> dict[str, np.ndarray]:
    """Weights for symbols with these counts, classes [bounds[i], bounds[i + 1]).

    The output biases start at the logs of the counts' shares, so an untrained model is the
    unigram model; everything that is learned comes on top.
    """
    rng = np.random.default_rng(seed)
    n, c = len(counts), len(bounds) - 1
    draw = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
    share = counts + 0.5
    by_class = np.add.reduceat(share, bounds[:-1])
    # The last row of Vc and column of Wo are the biases: states carry a one in that place.
    return {
        "E": draw(n, hidden, scale=0.3),
        "Wx": draw(hidden, 3 * hidden, scale=hidden**-0.5),
        "U": draw(hidden, 3 * hidden, scale=hidden**-0.5),
        "b": np.zeros(3 * hidden, np.float32),
        "Vc": np.vstack([draw(hidden, c, scale=0.05), np.log(by_class / by_class.sum()).astype(np.float32)]),
        "Wo": np.column_stack([draw(n, hidden, scale=0.05), np.log(share / np.repeat(by_class, np.diff(bounds))).astype(np.float32)]),
    }


def _steps(p: dict, x: np.ndarray, fresh: np.ndarray, h: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
    """Hidden states, with a one behind each, of a window; x are input symbols (time, lane), fresh marks documents' first steps."""
    hidden = h.shape[1]
    inputs = (p["table"] if "table" in p else p["E"] @ p["Wx"] + p["b"]).take(x, axis=0)
    states, kept = np.ones((*x.shape, hidden + 1), np.float32), []
    for t in range(len(x)):
        h = h * (1 - fresh[t])[:, None]
        u = h @ p["U"]
        gates = np.tanh(0.5 * (inputs[t, :, : 2 * hidden] + u[:, : 2 * hidden]))
        gates += 1
        gates *= 0.5
        z, r = gates[:, :hidden], gates[:, hidden:]
        cand = np.tanh(inputs[t, :, 2 * hidden :] + r * u[:, 2 * hidden :])
        if keep:
            kept.append((h, u[:, 2 * hidden :], z, r, cand))
        h = h + z * (cand - h)
        states[t, :, :hidden] = h
    return states, kept


def _segments(targets: np.ndarray, bounds: np.ndarray, class_of: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """Targets' order by class, and where each class begins in it."""
    classes = class_of.take(targets).astype(np.int16)
    order = np.argsort(classes, kind="stable")  # a radix sort for 16 bits
    return order, np.searchsorted(classes.take(order), np.arange(len(bounds))).tolist()


def _softmax(logits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numerators and denominators; the greatest logit is only taken off where exp overflows."""
    with np.errstate(over="ignore"):
        e = np.exp(logits)
        total = e @ np.ones(e.shape[1], np.float32)
    if not (np.isfinite(total).all() and total.min(initial=1.0) > 0):
        e = np.exp(logits - logits.max(axis=1, keepdims=True))
        total = e.sum(axis=1)
    return e, total


def log_probs(p: dict, bounds: np.ndarray, class_of: np.ndarray, states: np.ndarray, targets: np.ndarray) -> np.ndarray:
    """Natural logs of the targets' probabilities after these states (with their ones)."""
    order, starts = _segments(targets, bounds, class_of)
    states, targets = states.take(order, axis=0), targets.take(order)
    rows, edges = np.arange(len(targets)), bounds.tolist()
    e, total = _softmax(states @ p["Vc"])
    found = e[rows, class_of.take(targets)] / total
    inner = np.ones(len(targets), np.float32)
    for c, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False)):
        at, to = starts[c], starts[c + 1]
        if at < to and hi - lo > 1:
            e, total = _softmax(states[at:to] @ p["Wo"][lo:hi].T)
            inner[at:to] = e[rows[: to - at], targets[at:to] - lo] / total
    out = np.empty(len(targets))
    out[order] = np.log(found + TINY) + np.log(inner + TINY)
    return out


def score(p: dict, bounds: np.ndarray, class_of: np.ndarray, end: int, documents: list[np.ndarray]) -> np.ndarray:
    """The natural log probability of each document, a sequence of symbols without the end symbol."""
    p = p | {"table": p["E"] @ p["Wx"] + p["b"]}
    lanes = min(LANES_SCORE, max(1, len(documents)))
    lengths = np.array([len(d) + 1 for d in documents], np.int64)
    # Longest first, each to the lane that is shortest so far; lanes then end in order of length.
    load, holds = np.zeros(lanes, np.int64), [[] for _ in range(lanes)]
    for d in np.argsort(-lengths, kind="stable"):
        lane = int(load.argmin())
        holds[lane].append(d)
        load[lane] += lengths[d]
    order = np.argsort(-load, kind="stable")
    streams = [np.concatenate([np.append(documents[d], end) for d in holds[k]]) if holds[k] else np.empty(0, np.int64) for k in order]
    owners = [np.repeat(holds[k], lengths[holds[k]]) if holds[k] else np.empty(0, np.int64) for k in order]
    load = load[order]
    total = np.zeros(len(documents))
    h = np.zeros((lanes, p["U"].shape[0]), np.float32)
    last = np.full(lanes, end)
    for at in range(0, int(load.max(initial=0)), WINDOW_SCORE):
        n = int((load > at).sum())
        width = int(min(WINDOW_SCORE, load[0] - at))
        y = np.full((width, n), end)
        mine = np.full((width, n), -1)
        for k in range(n):
            part = streams[k][at : at + width]
            y[: len(part), k], mine[: len(part), k] = part, owners[k][at : at + width]
        x = np.concatenate([last[None, :n], y[:-1]])
        states, _ = _steps(p, x, (x == end).astype(np.float32), h[:n], False)
        h, last = states[-1, :, :-1], y[-1]
        real = (mine >= 0).reshape(-1)
        flat, aims = states.reshape(-1, states.shape[-1])[real], y.reshape(-1)[real]
        total += np.bincount(mine.reshape(-1)[real], weights=log_probs(p, bounds, class_of, flat, aims), minlength=len(documents))
    return total


class Trainer:
    """Adagrad over windows of lanes; feed documents with ``add``, windows run as lanes fill."""

    def __init__(self, params: dict, bounds: np.ndarray, class_of: np.ndarray, end: int) -> None:
        self.p = {k: v.copy() for k, v in params.items()}
        self.squares = {k: np.full(v.shape if k not in ("E", "Wo") else (len(v), 1), 1e-3, np.float32) for k, v in params.items()}
        self.bounds, self.class_of, self.end = bounds, class_of, end
        self.queue: list[np.ndarray] = []
        self.waiting = self.seen = 0

    def add(self, document: np.ndarray) -> None:
        self.queue.append(np.append(document, self.end))
        self.waiting += len(document) + 1
        if self.waiting >= WINDOWS_TRAIN * LANES_TRAIN * WINDOW_TRAIN:
            self.drain()

    def drain(self) -> None:
        """Trains on the waiting documents, laid end to end and cut into lanes for about WINDOWS_TRAIN steps."""
        if not self.waiting:
            return
        stream = np.concatenate(self.queue)
        self.queue, self.waiting = [], 0
        n = min(LANES_TRAIN, max(LANES_LEAST, len(stream) // (WINDOWS_TRAIN * WINDOW_TRAIN)))
        width = -(-len(stream) // n)
        # What is lacking in the last lane is made up from the stream's start.
        lanes = np.resize(stream, width * n).reshape(n, width).T
        self.last = np.concatenate([[self.end], lanes[-1, :-1]])  # a lane goes on where the one before it ends
        self.h = np.zeros((n, self.p["U"].shape[0]), np.float32)
        for at in range(0, width, WINDOW_TRAIN):
            y = lanes[at : at + WINDOW_TRAIN]
            x = np.concatenate([self.last[None], y[:-1]])
            self.window(x, y)
            self.last = y[-1].copy()
        self.seen += len(stream)

    def window(self, x: np.ndarray, y: np.ndarray) -> None:
        p, hidden = self.p, self.h.shape[1]
        fresh = (x == self.end).astype(np.float32)
        states, kept = _steps(p, x, fresh, self.h, True)
        self.h = states[-1, :, :hidden]
        aims = y.reshape(-1)
        n, edges = len(aims), self.bounds.tolist()
        order, starts = _segments(aims, self.bounds, self.class_of)
        flat, aims = states.reshape(n, -1).take(order, axis=0), aims.take(order)
        rows = np.arange(n)
        d, total = _softmax(flat @ p["Vc"])
        d /= total[:, None]
        d[rows, self.class_of.take(aims)] -= 1
        grad = d @ p["Vc"].T
        self._dense("Vc", flat.T @ d / n)
        for c, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False)):
            at, to = starts[c], starts[c + 1]
            if at == to or hi - lo == 1:
                continue
            own, out = flat[at:to], p["Wo"][lo:hi]
            d, total = _softmax(own @ out.T)
            d /= total[:, None]
            d[rows[: to - at], aims[at:to] - lo] -= 1
            grad[at:to] += d @ out
            step = d.T @ own
            step /= n
            square = self.squares["Wo"][lo:hi]
            square += np.einsum("ij,ij->i", step, step)[:, None] / step.shape[1]
            out -= RATE * step / np.sqrt(square)
        back = np.empty((n, hidden), np.float32)
        back[order] = grad[:, :hidden] / n
        self._through_time(x, fresh, kept, back.reshape(*x.shape, hidden))

    def _through_time(self, x: np.ndarray, fresh: np.ndarray, kept: list, grad: np.ndarray) -> None:
        p, hidden = self.p, self.h.shape[1]
        inner = np.empty((*x.shape, 3 * hidden), np.float32)
        outer = np.empty((*x.shape, 3 * hidden), np.float32)
        carry = np.zeros_like(grad[0])
        up = np.ascontiguousarray(p["U"].T)
        for t in range(len(x) - 1, -1, -1):
            h, u, z, r, cand = kept[t]
            dh = grad[t] + carry
            dc = dh * z * (1 - cand * cand)
            inner[t, :, :hidden] = dh * (cand - h) * z * (1 - z)
            inner[t, :, hidden : 2 * hidden] = dc * u * r * (1 - r)
            inner[t, :, 2 * hidden :] = dc
            outer[t, :, : 2 * hidden] = inner[t, :, : 2 * hidden]
            outer[t, :, 2 * hidden :] = dc * r
            carry = (dh * (1 - z) + outer[t] @ up) * (1 - fresh[t])[:, None]
        flat = inner.reshape(-1, 3 * hidden)
        before = np.stack([k[0] for k in kept]).reshape(-1, hidden)
        symbols = x.reshape(-1)
        by = np.argsort(symbols.astype(np.int16) if len(p["E"]) < 32_768 else symbols, kind="stable")
        ordered = symbols.take(by)
        first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        rows = np.add.reduceat((flat @ p["Wx"].T).take(by, axis=0), first, axis=0)
        embedded = p["E"].take(symbols, axis=0)
        touched = ordered.take(first)
        self._dense("U", before.T @ outer.reshape(-1, 3 * hidden))
        self._dense("Wx", embedded.T @ flat)
        self._dense("b", flat.sum(axis=0))
        square = self.squares["E"]
        square[touched] += np.einsum("ij,ij->i", rows, rows)[:, None] / hidden
        p["E"][touched] -= RATE * rows / np.sqrt(square[touched])

    def _dense(self, name: str, step: np.ndarray) -> None:
        norm = float(np.sqrt((step * step).sum()))
        if norm > CLIP:
            step = step * (CLIP / norm)
        self.squares[name] += step * step
        self.p[name] -= RATE * step / np.sqrt(self.squares[name])
