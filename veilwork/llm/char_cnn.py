"""A small convolutional network over characters, in numpy: forward, backward, Adam and Platt calibration.

A sample is a window of bytes and the number of body bytes (the candidate) that follow ``BEFORE`` bytes of
context. Characters are embedded, a flag marks the body, two convolutions follow, their outputs are pooled
over the body (largest and mean) and over the context (largest), and two dense layers give one logit.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

BEFORE, BODY, AFTER = 32, 64, 16
WINDOW = BEFORE + BODY + AFTER
#: Samples of a step of Adam.
BATCH = 128
_KERNEL, _EMBED, _FILTERS, _HIDDEN = 5, 8, (24, 32), 32
#: Class of each byte: absent (0), printable ASCII one by one, line breaks and tabs, other controls, parts of wider characters.
_CLASS = np.r_[0, np.full(31, 97), np.arange(1, 96), 97, np.full(128, 98)].astype(np.int64)
_CLASS[[9, 10, 13]] = 96
N_CLASSES = 99


def initial(seed: int = 0) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    layer = lambda n, m: (rng.standard_normal((n, m)) * np.sqrt(2 / n)).astype(np.float32)
    one, two = _FILTERS
    return {
        "embed": (rng.standard_normal((N_CLASSES, _EMBED)) * 0.3).astype(np.float32),
        "w1": layer(_KERNEL * (_EMBED + 1), one), "b1": np.zeros(one, np.float32),
        "w2": layer(_KERNEL * one, two), "b2": np.zeros(two, np.float32),
        "w3": layer(3 * two, _HIDDEN), "b3": np.zeros(_HIDDEN, np.float32),
        "w4": layer(_HIDDEN, 1), "b4": np.zeros(1, np.float32),
    }


def _columns(x: np.ndarray) -> np.ndarray:
    """The kernel's neighbourhood of each position, side by side (n x length x kernel * channels)."""
    half = _KERNEL // 2
    padded = np.pad(x, ((0, 0), (half, half), (0, 0)))
    return np.concatenate([padded[:, k : k + x.shape[1]] for k in range(_KERNEL)], axis=2)


def _back_to_inputs(columns: np.ndarray, channels: int) -> np.ndarray:
    n, length, _ = columns.shape
    half = _KERNEL // 2
    out = np.zeros((n, length + 2 * half, channels), columns.dtype)
    for k in range(_KERNEL):
        out[:, k : k + length] += columns[:, :, k * channels : (k + 1) * channels]
    return out[:, half : half + length]


def forward(w: dict[str, np.ndarray], windows: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, tuple]:
    """Logits of the samples, and what ``backward`` needs."""
    at = np.arange(windows.shape[1])
    body = (at >= BEFORE) & (at < BEFORE + sizes[:, None])
    kinds = _CLASS[windows]
    x = np.concatenate([w["embed"][kinds], body[:, :, None].astype(w["embed"].dtype)], axis=2)
    c1 = _columns(x)
    h1 = np.maximum(c1 @ w["w1"] + w["b1"], 0)
    c2 = _columns(h1)
    h2 = np.maximum(c2 @ w["w2"] + w["b2"], 0)
    inside, around = body[:, :, None], (~body & (kinds > 0))[:, :, None]
    in_body, outside = np.where(inside, h2, -1), np.where(around, h2, -1)
    pooled = np.concatenate([in_body.max(1), (h2 * inside).sum(1) / np.maximum(sizes, 1)[:, None], np.maximum(outside.max(1), 0)], axis=1).astype(h2.dtype)
    h3 = np.maximum(pooled @ w["w3"] + w["b3"], 0)
    logit = (h3 @ w["w4"] + w["b4"])[:, 0]
    return logit, (kinds, body, sizes, c1, h1, c2, h2, in_body, outside, pooled, h3)


def backward(w: dict[str, np.ndarray], kept: tuple, d_logit: np.ndarray) -> dict[str, np.ndarray]:
    kinds, body, sizes, c1, h1, c2, h2, in_body, outside, pooled, h3 = kept
    n, (one, two) = np.arange(len(d_logit))[:, None], _FILTERS
    g = {"w4": h3.T @ d_logit[:, None], "b4": d_logit.sum(keepdims=True)}
    d3 = (d_logit[:, None] @ w["w4"].T) * (h3 > 0)
    g |= {"w3": pooled.T @ d3, "b3": d3.sum(0)}
    d_pooled = d3 @ w["w3"].T
    d2 = body[:, :, None] * (d_pooled[:, None, two : 2 * two] / np.maximum(sizes, 1)[:, None, None])
    channel = np.arange(two)
    d2[n, in_body.argmax(1), channel] += d_pooled[:, :two] * (sizes > 0)[:, None]
    d2[n, outside.argmax(1), channel] += d_pooled[:, 2 * two :] * (outside.max(1) > 0)
    d2 = (d2 * (h2 > 0)).astype(h2.dtype)
    flat = lambda x: x.reshape(-1, x.shape[-1])
    g |= {"w2": flat(c2).T @ flat(d2), "b2": flat(d2).sum(0)}
    d1 = _back_to_inputs(d2 @ w["w2"].T, one) * (h1 > 0)
    g |= {"w1": flat(c1).T @ flat(d1), "b1": flat(d1).sum(0)}
    dx = flat(_back_to_inputs(d1 @ w["w1"].T, _EMBED + 1)[:, :, :_EMBED])
    g["embed"] = np.stack([np.bincount(kinds.ravel(), dx[:, e], N_CLASSES) for e in range(_EMBED)], axis=1)
    return g


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def logits(w: dict[str, np.ndarray], windows: np.ndarray, sizes: np.ndarray, at_once: int = 256) -> np.ndarray:
    parts = [forward(w, windows[i : i + at_once], sizes[i : i + at_once])[0] for i in range(0, len(windows), at_once)]
    return np.concatenate(parts) if parts else np.zeros(0, np.float32)


def flat(*parts: dict[str, np.ndarray]) -> np.ndarray:
    """Weights (or the means that Adam keeps of them) one after another, as one vector."""
    return np.concatenate([x.ravel() for part in parts for x in part.values()])


def unflat(vector: np.ndarray) -> list[dict[str, np.ndarray]]:
    """The parts that ``flat`` joined; they can be written to."""
    shapes = {k: x.shape for k, x in initial().items()}
    out, at = [], 0
    while at < len(vector):
        out.append({})
        for k, shape in shapes.items():
            n = int(np.prod(shape))
            out[-1][k] = np.array(vector[at : at + n], np.float32).reshape(shape)
            at += n
    return out


def one_pass(
    state: np.ndarray, step: int, windows: np.ndarray, sizes: np.ndarray, labels: np.ndarray, weight: np.ndarray, rng: np.random.Generator,
    rate: float = 2e-3,
) -> np.ndarray:
    """Adam on the weighted logistic loss, each sample once; ``state`` is ``flat`` of weights, means and squares after ``step`` steps."""
    w, m, v = unflat(state)
    order = rng.permutation(len(labels))
    for i in range(0, len(order), BATCH):
        b, step = order[i : i + BATCH], step + 1
        z, kept = forward(w, windows[b], sizes[b])
        g = backward(w, kept, ((sigmoid(z) - labels[b]) * weight[b] / len(b)).astype(np.float32))
        for k in w:
            m[k], v[k] = 0.9 * m[k] + 0.1 * g[k], 0.999 * v[k] + 0.001 * g[k] ** 2
            w[k] = (w[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return flat(w, m, v).astype(np.float32)


def platt_targets(pos: int, neg: int) -> tuple[float, float]:
    """Smoothed targets of a negative and of a positive."""
    return 1 / (neg + 2), (pos + 1) / (pos + 2)


def platt_by_sums(sums: Callable[[float, float], tuple], steps: int = 50) -> tuple[float, float]:
    """Newton's method; ``sums(a, b)`` gives the loss, its two first and its three second derivatives (aa, ab, bb)."""
    theta, now = np.array([1.0, 0.0]), sums(1.0, 0.0)
    for _ in range(steps):
        step, size = np.linalg.solve(np.array([[now[3], now[4]], [now[4], now[5]]]) + 1e-6 * np.eye(2), np.array(now[1:3])), 1.0
        new = sums(*(theta - step))
        while size > 1e-6 and new[0] > now[0] + 1e-12 * abs(now[0]):
            size /= 2
            new = sums(*(theta - size * step))
        theta, now = theta - size * step, new
        if np.abs(size * step).max() < 1e-9:
            break
    return float(theta[0]), float(theta[1])


def platt(z: np.ndarray, labels: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """(a, b) so that sigmoid(a * z + b) is the probability: Newton's method with smoothed targets."""
    target, x = np.array(platt_targets((labels == 1).sum(), (labels == 0).sum()))[(labels == 1).astype(int)], z.astype(float)

    def sums(a: float, b: float) -> tuple:
        value = a * x + b
        p = sigmoid(value)
        d, q = p - target, p * (1 - p)
        return (np.logaddexp(0, value) - target * value).sum(), (d * x).sum(), d.sum(), (q * x * x).sum(), (q * x).sum(), q.sum()

    return platt_by_sums(sums, steps)


def threshold_for_recall(p: np.ndarray, labels: np.ndarray, recall: float) -> float:
    """The highest probability that still accepts the share ``recall`` of the positives."""
    found = np.sort(p[labels == 1])[::-1]
    return float(found[max(int(np.ceil(recall * len(found))) - 1, 0)])


@dataclass(frozen=True)
class Detector:
    """A trained network, its calibration and the least probability that it reports."""

    weights: dict
    a: float
    b: float
    threshold: float

    def probabilities(self, windows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        return sigmoid(self.a * logits(self.weights, windows, sizes).astype(float) + self.b)
