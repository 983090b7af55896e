"""Linear models fitted on the driver from a bounded sample: FTRL-proximal with elastic net, temperature."""

from __future__ import annotations

import numpy as np


class SoftmaxFTRL:
    """Multinomial logistic regression by follow-the-regularised-leader (McMahan et al. 2013).

    Rows are sparse (indices, values); per coordinate and class, l1 keeps weights at exactly zero and l2 shrinks them.
    """

    def __init__(self, features: int, classes: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.002):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros((features + 1, classes)), np.zeros((features + 1, classes))  # the last row is the bias

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z = self.z[at]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2))

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], targets: np.ndarray, epochs: int = 3, seed: int = 1) -> SoftmaxFTRL:
        """targets: a row of class probabilities for each row (one-hot, or soft)."""
        rng, bias = np.random.default_rng(seed), len(self.z) - 1
        for _ in range(epochs):
            for r in rng.permutation(len(rows)):
                at, x = np.append(rows[r][0], bias), np.append(rows[r][1], 1.0)
                w = self.weights(at)
                g = x[:, None] * (softmax(x @ w) - targets[r])
                new = self.n[at] + g * g
                self.z[at] += g - (np.sqrt(new) - np.sqrt(self.n[at])) / self.alpha * w
                self.n[at] = new
        return self


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least negative log-likelihood on held-back rows, by golden section on its logarithm."""
    if not len(logits):
        return 1.0

    def loss(t: float) -> float:
        p = softmax(logits / np.exp(t))
        return -float(np.log(np.maximum(p[np.arange(len(labels)), labels], 1e-300)).mean())

    lo, hi, g = np.log(0.05), np.log(20.0), (5**0.5 - 1) / 2
    for _ in range(60):
        a, b = hi - g * (hi - lo), lo + g * (hi - lo)
        lo, hi = (lo, b) if loss(a) <= loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))
