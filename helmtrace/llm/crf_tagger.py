"""A character-level bidirectional LSTM with CRF transitions, in numpy.

Windows of ``WINDOW`` characters are tagged O, B-kind or I-kind. Training is plain back-propagation
through time with the CRF's forward-backward marginals; decoding is Viterbi over a whole batch.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

WINDOW = 64
EMBEDDING, HIDDEN = 12, 16
_PAD, _LETTER, _REST, _CHARS = 0, 129, 130, 131


def char_ids(text: str, size: int = WINDOW) -> np.ndarray:
    """ASCII by itself, other letters and other characters as one id each, padded with 0 to ``size``."""
    points = np.frombuffer(text[:size].encode("utf-32-le", "replace"), dtype=np.uint32).astype(np.int64)
    ids = points + 1
    for i in np.flatnonzero(points > 127):
        ids[i] = _LETTER if chr(points[i]).isalpha() else _REST
    return np.concatenate((ids, np.full(size - len(ids), _PAD, dtype=np.int64)))


def tags_of(kinds: list[str]) -> list[str]:
    return ["O", *[f"{mark}-{kind}" for kind in kinds for mark in "BI"]]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def _lstm(x: np.ndarray, w: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, tuple]:
    """Hidden states of inputs ``(steps, batch, width)``; ``w`` takes input and hidden state side by side."""
    steps, batch, _ = x.shape
    size = len(b) // 4
    h, c = np.zeros((steps + 1, batch, size), x.dtype), np.zeros((steps + 1, batch, size), x.dtype)
    gates = np.empty((steps, batch, 4 * size), x.dtype)
    wx, wh = w[: x.shape[2]], w[x.shape[2] :]
    ahead = x @ wx + b
    for t in range(steps):
        z = ahead[t] + h[t] @ wh
        z[:, : 3 * size] = _sigmoid(z[:, : 3 * size])
        z[:, 3 * size :] = np.tanh(z[:, 3 * size :])
        gates[t] = z
        i, f, o, g = (z[:, k * size : (k + 1) * size] for k in range(4))
        c[t + 1] = f * c[t] + i * g
        h[t + 1] = o * np.tanh(c[t + 1])
    return h[1:], (x, h, c, gates)


def _lstm_back(dh: np.ndarray, saved: tuple, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x, h, c, gates = saved
    steps, batch, width = x.shape
    size = h.shape[2]
    dz_all = np.empty_like(gates)
    carry_h, carry_c = np.zeros((batch, size), x.dtype), np.zeros((batch, size), x.dtype)
    wh = w[width:]
    for t in range(steps - 1, -1, -1):
        i, f, o, g = (gates[t][:, k * size : (k + 1) * size] for k in range(4))
        th = np.tanh(c[t + 1])
        dht = dh[t] + carry_h
        dc = carry_c + dht * o * (1 - th * th)
        dz = dz_all[t]
        dz[:, :size] = dc * g * i * (1 - i)
        dz[:, size : 2 * size] = dc * c[t] * f * (1 - f)
        dz[:, 2 * size : 3 * size] = dht * th * o * (1 - o)
        dz[:, 3 * size :] = dc * i * (1 - g * g)
        carry_c = dc * f
        carry_h = dz @ wh.T
    flat = dz_all.reshape(-1, 4 * size)
    dw = np.concatenate((x.reshape(-1, width).T @ flat, h[:-1].reshape(-1, size).T @ flat))
    return dz_all @ w[:width].T, dw, flat.sum(axis=0)


@dataclass
class Tagger:
    """Weights by name, and the kinds of spans."""

    kinds: list[str]
    weights: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def fresh(cls, kinds: list[str], seed: int = 7) -> Tagger:
        rng = np.random.default_rng(seed)
        tags = 1 + 2 * len(kinds)

        def scaled(*shape: int) -> np.ndarray:
            return (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)

        w = {"embed": scaled(_CHARS, EMBEDDING) * 3, "out": scaled(2 * HIDDEN, tags), "out_b": np.zeros(tags, np.float32)}
        for way in ("fore", "back"):
            w[way] = scaled(EMBEDDING + HIDDEN, 4 * HIDDEN)
            w[way + "_b"] = np.zeros(4 * HIDDEN, np.float32)
            w[way + "_b"][HIDDEN : 2 * HIDDEN] = 1.0
        w["moves"], w["first"] = np.zeros((tags, tags), np.float32), np.zeros(tags, np.float32)
        return cls(kinds, w)

    def emissions(self, ids: np.ndarray) -> tuple[np.ndarray, tuple]:
        """Scores ``(steps, batch, tags)`` of windows ``(batch, steps)``."""
        w = self.weights
        x = w["embed"][ids.T]
        fore, saved_fore = _lstm(x, w["fore"], w["fore_b"])
        back, saved_back = _lstm(x[::-1], w["back"], w["back_b"])
        both = np.concatenate((fore, back[::-1]), axis=2)
        return both @ w["out"] + w["out_b"], (ids, both, saved_fore, saved_back)

    def forbidden(self) -> np.ndarray:
        """A penalty on I-kind after anything but B-kind or I-kind."""
        tags = 1 + 2 * len(self.kinds)
        out = np.zeros((tags, tags), np.float32)
        for k in range(len(self.kinds)):
            inner = 2 * k + 2
            out[:, inner] = -1e4
            out[[inner - 1, inner], inner] = 0
        return out

    def loss_and_gradient(self, ids: np.ndarray, gold: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log likelihood of tags ``(batch, steps)``, and its gradient for every weight."""
        w = self.weights
        scores, (ids, both, saved_fore, saved_back) = self.emissions(ids)
        steps, batch, tags = scores.shape
        moves, gold = w["moves"] + self.forbidden(), gold.T
        alpha = np.empty_like(scores)
        alpha[0] = scores[0] + w["first"]
        for t in range(1, steps):
            alpha[t] = _logsum(alpha[t - 1][:, :, None] + moves, 1) + scores[t]
        total = _logsum(alpha[-1], 1)
        beta = np.zeros_like(scores)
        pair_sum = np.zeros((tags, tags), np.float64)
        for t in range(steps - 1, 0, -1):
            tail = scores[t] + beta[t]
            joint = moves + tail[:, None, :]
            pair_sum += np.exp(alpha[t - 1][:, :, None] + joint - total[:, None, None]).sum(axis=0)
            beta[t - 1] = _logsum(joint, 2)
        share = np.exp(alpha + beta - total[None, :, None])
        rows = np.arange(batch)
        path = w["first"][gold[0]] + scores[0][rows, gold[0]]
        for t in range(1, steps):
            path = path + moves[gold[t - 1], gold[t]] + scores[t][rows, gold[t]]
        d_scores = share.copy()
        d_scores[np.arange(steps)[:, None], rows[None, :], gold] -= 1
        d_scores = (d_scores / batch).astype(np.float32)
        grad = {"first": d_scores[0].sum(axis=0)}
        np.subtract.at(pair_sum, (gold[:-1].ravel(), gold[1:].ravel()), 1)
        grad["moves"] = (pair_sum / batch).astype(np.float32)
        flat = d_scores.reshape(-1, tags)
        grad["out"], grad["out_b"] = both.reshape(-1, 2 * HIDDEN).T @ flat, flat.sum(axis=0)
        d_both = d_scores @ w["out"].T
        dx, grad["fore"], grad["fore_b"] = _lstm_back(d_both[:, :, :HIDDEN], saved_fore, w["fore"])
        dx_back, grad["back"], grad["back_b"] = _lstm_back(np.ascontiguousarray(d_both[::-1, :, HIDDEN:]), saved_back, w["back"])
        grad["embed"] = np.zeros_like(w["embed"])
        np.add.at(grad["embed"], ids.T.ravel(), (dx + dx_back[::-1]).reshape(-1, EMBEDDING))
        return float((total - path).mean()), grad

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best tags ``(batch, steps)`` and how sure each is: its marginal probability, by forward and backward sums."""
        scores, _ = self.emissions(ids)
        steps, batch, tags = scores.shape
        moves = self.weights["moves"] + self.forbidden()
        best = scores[0] + self.weights["first"]
        back = np.empty((steps, batch, tags), np.int8)
        for t in range(1, steps):
            reach = best[:, :, None] + moves
            back[t] = reach.argmax(axis=1)
            best = reach.max(axis=1) + scores[t]
        out = np.empty((batch, steps), np.int64)
        out[:, -1] = best.argmax(axis=1)
        rows = np.arange(batch)
        for t in range(steps - 1, 0, -1):
            out[:, t - 1] = back[t][rows, out[:, t]]
        alpha, beta = np.empty_like(scores), np.zeros_like(scores)
        alpha[0] = scores[0] + self.weights["first"]
        for t in range(1, steps):
            alpha[t] = _logsum(alpha[t - 1][:, :, None] + moves, 1) + scores[t]
        for t in range(steps - 1, 0, -1):
            beta[t - 1] = _logsum(moves + (scores[t] + beta[t])[:, None, :], 2)
        shares = np.exp(alpha + beta - _logsum(alpha[-1], 1)[None, :, None])
        return out, shares.transpose(1, 0, 2)[rows[:, None], np.arange(steps)[None, :], out]


def gold_tags(spans: list[tuple[int, int, str]], kinds: list[str], size: int = WINDOW) -> np.ndarray:
    """Tags of a window from its spans ``(start, end, kind)``; parts beyond the window are cut off."""
    out = np.zeros(size, dtype=np.int64)
    for start, end, kind in spans:
        k = kinds.index(kind)
        start, end = max(0, start), min(size, end)
        if start < end:
            out[start:end] = 2 * k + 2
            out[start] = 2 * k + 1
    return out


def train(examples: list[tuple[str, list[tuple[int, int, str]]]], kinds: list[str], steps: int = 160, batch: int = 96, rate: float = 0.02, seed: int = 7) -> Tagger:
    """Fits a tagger to windows with labelled spans, by Adam. The same examples give the same weights."""
    tagger = Tagger.fresh(kinds, seed)
    ids = np.stack([char_ids(text) for text, _ in examples])
    gold = np.stack([gold_tags(spans, kinds) for _, spans in examples])
    rng = np.random.default_rng(seed)
    mean = {k: np.zeros_like(v) for k, v in tagger.weights.items()}
    square = {k: np.zeros_like(v) for k, v in tagger.weights.items()}
    for step in range(1, steps + 1):
        pick = rng.integers(0, len(ids), min(batch, len(ids)))
        _, grad = tagger.loss_and_gradient(ids[pick], gold[pick])
        norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
        shrink = min(1.0, 5.0 / (norm + 1e-9))
        now = rate * min(1.0, 2 * (1 - step / (steps + 1)))
        for k, g in grad.items():
            g = g * shrink
            mean[k] = 0.9 * mean[k] + 0.1 * g
            square[k] = 0.99 * square[k] + 0.01 * g * g
            up, down = mean[k] / (1 - 0.9**step), np.sqrt(square[k] / (1 - 0.99**step)) + 1e-8
            tagger.weights[k] = (tagger.weights[k] - now * up / down).astype(np.float32)
    return tagger
