"""A gated recurrent language model in numpy: truncated backpropagation, class-factored output softmax.

Tokens are the most frequent words, one token per ending for all other words, and the end of a text. Words
belong to classes of similar frequency; a word's probability is that of its class times that of the
word in the class. The hidden state runs on from window to window through a whole text; gradients stop
at the windows' edges.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

END = 0
#: Rows of the output layer worked on at once; of the classes, so that their outputs stay in the cache.
_ROWS, _CLASS_ROWS = 1 << 16, 1 << 12


@dataclass
class Layout:
    """Token numbers: 0 the end, then ``shapes`` endings, then words in classes of ``per_class``."""

    shapes: int
    words: int
    per_class: int = 32

    @property
    def tokens(self) -> int:
        return 1 + self.shapes + self.words

    @property
    def single(self) -> int:
        """Classes of one token: the end and the endings."""
        return 1 + self.shapes

    @property
    def classes(self) -> int:
        return self.single + -(-self.words // self.per_class)

    def class_of(self, token: np.ndarray) -> np.ndarray:
        return np.where(token < self.single, token, self.single + (token - self.single) // self.per_class)


@dataclass
class Weights:
    """All parameters; ``flat`` and ``unflat`` turn them into one vector and back."""

    layout: Layout
    hidden: int
    parts: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def start(cls, layout: Layout, hidden: int, log_p: np.ndarray, seed: int = 5) -> Weights:
        """Small random weights whose output biases give every token its share ``log_p`` (natural logarithms)."""
        rng = np.random.default_rng(seed)
        h = hidden
        near = lambda *shape: (rng.standard_normal(shape) / np.sqrt(h)).astype(np.float32)
        p = np.exp(log_p)
        per_class = np.bincount(layout.class_of(np.arange(layout.tokens)), weights=p, minlength=layout.classes)
        rows = (layout.classes - layout.single) * layout.per_class
        word_bias = np.full(rows, -30.0, np.float32)
        word_bias[: layout.words] = log_p[layout.single :]
        parts = {
            "embed": 0.5 * near(layout.tokens, h),
            "into": near(h, 3 * h),
            "state": near(h, 3 * h),
            "bias": np.concatenate([np.full(h, -1.0), np.zeros(2 * h)]).astype(np.float32),
            "class_w": np.zeros((h, layout.classes), np.float32),
            "class_b": np.log(per_class).astype(np.float32),
            "word_w": np.zeros((rows, h), np.float32),
            "word_b": word_bias,
        }
        return cls(layout, hidden, parts)

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parts.values()])

    def unflat(self, values: np.ndarray) -> Weights:
        parts, at = {}, 0
        for name, p in self.parts.items():
            parts[name] = np.asarray(values[at : at + p.size], np.float32).reshape(p.shape)
            at += p.size
        return Weights(self.layout, self.hidden, parts)


def _sigmoid(x: np.ndarray, out: np.ndarray) -> np.ndarray:
    """Into ``out``; exponentials that overflow give the limit 0."""
    np.negative(x, out=out)
    np.exp(out, out=out)
    out += 1
    return np.reciprocal(out, out=out)


def _step(turned: np.ndarray, x: np.ndarray, h: np.ndarray, n: int):
    """One step of the gated unit: update and reset ``g``, candidate ``c``, ``u`` = what the reset lets through.

    Numbers of a state are rows and texts columns, so that every gate is one run of memory. ``turned`` has a row
    per output of a state, ``x`` is used up.
    """
    from_state = turned @ h
    u = from_state[2 * n :]
    from_state[: 2 * n] += x[: 2 * n]
    g = _sigmoid(from_state[: 2 * n], x[: 2 * n])
    c = x[2 * n :]
    c += g[n:] * u
    c *= 2
    _sigmoid(c, c)  # tanh(c) = 2 sigmoid(2 c) - 1
    c *= 2
    c -= 1
    after = c - h
    after *= g[:n]
    after += h
    return g, u, c, after


def _exponentials(x: np.ndarray, bound: float) -> np.ndarray:
    """``exp(x)`` in place, up to a factor per row; without one where ``bound`` keeps the numbers in range."""
    if not bound < 80:
        x -= x.max(axis=1, keepdims=True)
    return np.exp(x, out=x)


def _bound(layer: np.ndarray) -> float:
    """No output of states between -1 and 1 is further from 0."""
    return float(np.abs(layer).sum(axis=0).max()) if layer.size else 0.0


def _layers(p: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Outputs of classes and of words as matrices over a state and a last entry 1, which takes the bias."""
    return np.vstack((p["class_w"], p["class_b"])), np.vstack((p["word_w"].T, p["word_b"]))


def _log_share(x: np.ndarray, at: np.ndarray, bound: float) -> np.ndarray:
    """Log probability of entry ``at`` of each row of outputs ``x``, which is used up."""
    rows = np.arange(len(at))
    if not bound < 80:
        x -= x.max(axis=1, keepdims=True)
    own = x[rows, at]
    np.exp(x, out=x)
    return own - np.log(x @ np.ones(x.shape[1], x.dtype))


def _sorted_places(numbers: np.ndarray, below: int) -> np.ndarray:
    """Stable order of numbers from 0; numbers of 16 bits are sorted by their digits."""
    return np.argsort(numbers.astype(np.uint16) if below <= 1 << 16 else numbers, kind="stable")


def _by_class(layout: Layout, token: np.ndarray):
    """For every class of several words among ``token``: its number, the rows with it, their word in it."""
    word = np.flatnonzero(token >= layout.single)
    if len(word) == 0:
        return
    nth = (token[word] - layout.single) // layout.per_class
    order = _sorted_places(nth, layout.classes)
    word, nth = word[order], nth[order]
    edges = np.flatnonzero(np.diff(nth, prepend=-1))
    for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(word)], strict=True):
        rows = word[a:b]
        yield int(nth[a]), rows, (token[rows] - layout.single) % layout.per_class


def log_probability(w: Weights, h: np.ndarray, token: np.ndarray) -> np.ndarray:
    """Natural log probability of each token after the state in the same row; states end with a 1."""
    layout = w.layout
    classes, words = _layers(w.parts)
    bound, own = _bound(classes), layout.class_of(token)
    out = np.empty(len(token), h.dtype)
    for a in range(0, len(token), _CLASS_ROWS):
        rows = slice(a, a + _CLASS_ROWS)
        out[rows] = _log_share(h[rows] @ classes, own[rows], bound)
    bound = _bound(words)
    for k, rows, word in _by_class(layout, token):
        part = words[:, k * layout.per_class : (k + 1) * layout.per_class]
        out[rows] += _log_share(h.take(rows, axis=0) @ part, word, bound)
    return out


def score(
    w: Weights, token: np.ndarray, offsets: np.ndarray, window: int = _ROWS // 4, lanes: int = 1024
) -> np.ndarray:
    """Natural log probability of each text, its end included; texts' tokens (END last) lie one after another.

    ``lanes`` texts of similar length are read side by side; states are kept until there are ``window`` of them,
    then the output layer takes them all, and the last ones go on into the next window.
    """
    order = np.argsort(-np.diff(offsets), kind="stable")
    into = np.ascontiguousarray((w.parts["embed"] @ w.parts["into"] + w.parts["bias"]).T)
    out = np.empty(len(order))
    for a in range(0, len(order), lanes):
        texts = order[a : a + lanes]
        out[texts] = _score_lanes(w, into, token, offsets[:-1][texts], np.diff(offsets)[texts], window)
    return out


def _score_lanes(
    w: Weights, into: np.ndarray, token: np.ndarray, start: np.ndarray, size: np.ndarray, window: int
) -> np.ndarray:
    """Scores of the texts at ``start``, longest first; ``into`` has a column per token."""
    n = w.hidden
    turned = np.ascontiguousarray(w.parts["state"].T)
    out = np.zeros(len(size))
    h = np.zeros((n, len(size)), np.float32)
    longest = int(size[0])
    active = np.searchsorted(-size, -np.arange(longest + 1), side="left")  # texts with more tokens than that
    states, targets, held = [], [], 0
    last = np.full(len(size), END)  # before the first token comes the end of nothing
    for t in range(longest):
        m = int(active[t])
        x = into.take(targets[-1][:m] if targets else last[:m], axis=1, mode="clip")
        with np.errstate(over="ignore"):
            h = _step(turned, x, h[:, :m], n)[3]
        states.append(h)
        targets.append(token.take(start[:m] + t))
        held += m
        if held < window and t + 1 < longest:
            continue
        flat, wanted = np.ones((held, n + 1), np.float32), np.concatenate(targets)
        np.concatenate([s.T for s in states], out=flat[:, :n])
        found = [log_probability(w, flat[k : k + _ROWS], wanted[k : k + _ROWS]) for k in range(0, held, _ROWS)]
        owners = np.concatenate([np.arange(len(s)) for s in targets])
        out[: len(targets[0])] += np.bincount(owners, weights=np.concatenate(found), minlength=len(targets[0]))
        last = targets[-1]
        states, targets, held = [], [], 0
    return out


def _through(
    layer: np.ndarray, states: np.ndarray, own: np.ndarray, weight: np.ndarray, bound: float
) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the rows' losses, by ``weight``, with regard to an output layer and to its states.

    What divides or weighs a row is applied to its state, which is shorter than its outputs.
    """
    x = _exponentials(states @ layer, bound)
    total = x @ np.ones(x.shape[1], x.dtype)
    x[np.arange(len(own)), own] -= total
    share = (weight / total)[:, None]
    return (states * share).T @ x, (x @ layer[:-1].T) * share


def _gradients(
    w: Weights, inputs: np.ndarray, targets: np.ndarray, h: np.ndarray, live: np.ndarray | None = None
) -> tuple[dict, np.ndarray]:
    """Gradients of the mean loss of a window (steps x lanes), and the state (hidden x lanes) after it. Only
    targets that are ``live`` (all, unless given) count."""
    p, layout, n = w.parts, w.layout, w.hidden
    steps, lanes = inputs.shape
    into = np.ascontiguousarray((p["embed"] @ p["into"] + p["bias"]).T)
    turned = np.ascontiguousarray(p["state"].T)
    go_on = (inputs != END).astype(h.dtype)  # a new text starts with nothing
    before, kept = [], []
    after = np.empty((n, steps, lanes), h.dtype)
    with np.errstate(over="ignore"):
        for t in range(steps):
            before.append(h * go_on[t])
            g, u, c, h = _step(turned, into.take(inputs[t], axis=1, mode="clip"), before[t], n)
            kept.append((g, u, c))
            after[:, t] = h
    flat, token = np.ones((steps * lanes, n + 1), h.dtype), targets.ravel()
    flat[:, :n] = after.reshape(n, -1).T
    weight = np.ones(len(token), h.dtype) if live is None else live.ravel().astype(h.dtype)
    weight /= max(h.dtype.type(1), weight.sum())
    grad = {}
    classes, words = _layers(p)
    bound, own = _bound(classes), layout.class_of(token)
    back, sums = np.empty((len(token), n), h.dtype), np.zeros_like(classes)
    for a in range(0, len(token), _CLASS_ROWS):
        rows = slice(a, a + _CLASS_ROWS)
        found, back[rows] = _through(classes, flat[rows], own[rows], weight[rows], bound)
        sums += found
    grad["class_w"], grad["class_b"] = sums[:-1], sums[-1]
    bound, sums = _bound(words), np.zeros_like(words)
    for k, rows, word in _by_class(layout, token):
        part = slice(k * layout.per_class, (k + 1) * layout.per_class)
        states = flat.take(rows, axis=0)
        sums[:, part], found = _through(words[:, part], states, word, weight.take(rows), bound)
        back[rows] += found
    grad["word_w"], grad["word_b"] = sums[:-1].T, sums[-1]
    back = np.ascontiguousarray(back.T).reshape(n, steps, lanes)
    d_into = np.empty((3 * n, steps, lanes), h.dtype)
    d_state, d_next = np.empty((3 * n, lanes), h.dtype), np.zeros((n, lanes), h.dtype)
    grad["state"] = np.zeros_like(p["state"])
    for t in range(steps - 1, -1, -1):
        g, u, c = kept[t]
        z, r = g[:n], g[n:]
        d = back[:, t] + d_next
        through = d * z
        d_next = d - through
        d_c, gates = d_into[2 * n :, t], d_state[: 2 * n]
        np.multiply(c, c, out=d_c)
        np.subtract(1, d_c, out=d_c)
        d_c *= through
        np.subtract(1, g, out=gates)
        gates *= g
        gates[:n] *= d * (c - before[t])
        gates[n:] *= d_c * u
        d_into[: 2 * n, t] = gates
        np.multiply(d_c, r, out=d_state[2 * n :])
        d_next += p["state"] @ d_state
        d_next *= go_on[t]
        grad["state"] += before[t] @ d_state.T
    d_into = d_into.reshape(3 * n, -1)
    grad["bias"] = d_into.sum(axis=1)
    # What belongs to one token is summed after sorting by token.
    token = inputs.ravel()
    order = _sorted_places(token, layout.tokens)
    first = np.flatnonzero(np.diff(token[order], prepend=-1))
    per_token = np.add.reduceat(d_into.take(order, axis=1), first, axis=1)
    used = token[order][first]
    grad["into"] = (per_token @ p["embed"][used]).T
    grad["embed"] = np.zeros_like(p["embed"])
    grad["embed"][used] = (p["into"] @ per_token).T
    return grad, h


def train(
    w: Weights, token: np.ndarray, lanes: int = 384, window: int = 24, rate: float = 0.01, clip: float = 1.0
) -> Weights:
    """``w`` after one pass over a stream of texts (each ended by END) by Adam.

    Up to ``lanes`` stretches of the stream are read side by side, fewer where that would leave less than a
    hundred windows. The last one is filled up to the length of the others; what fills it does not count.
    """
    stream = np.concatenate(([END], token))
    lanes = max(1, min(lanes, (len(stream) - 1) // (100 * window)))
    length = -(-(len(stream) - 1) // lanes)
    filled = np.concatenate((stream, np.full(lanes * length + 1 - len(stream), END, stream.dtype)))
    inputs = filled[:-1].reshape(lanes, length).T
    targets = filled[1:].reshape(lanes, length).T
    live = (np.arange(lanes * length) < len(stream) - 1).reshape(lanes, length).T
    parts = {k: v.copy() for k, v in w.parts.items()}
    first = {k: np.zeros_like(v) for k, v in parts.items()}
    second = {k: np.zeros_like(v) for k, v in parts.items()}
    now = Weights(w.layout, w.hidden, parts)
    h = np.zeros((w.hidden, lanes), np.float32)
    n_windows = -(-length // window)
    for step, at in enumerate(range(0, length, window)):
        part = slice(at, at + window)
        g, h = _gradients(now, *(np.ascontiguousarray(x[part]) for x in (inputs, targets)), h, live[part])
        norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
        scale = min(1.0, clip / max(norm, 1e-9))
        pace = rate * (1 - 0.9 * step / n_windows) * min(1.0, (step + 1) / 20)
        for k, x in g.items():
            x = x * np.float32(scale)
            first[k] += 0.1 * (x - first[k])
            second[k] += 0.01 * (x * x - second[k])
            up, down = first[k] / (1 - 0.9 ** (step + 1)), second[k] / (1 - 0.99 ** (step + 1))
            parts[k] -= np.float32(pace) * up / (np.sqrt(down) + 1e-8)
    return now
