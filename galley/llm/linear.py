"""Sparse rows and linear models that are fitted on the driver, on bounded samples."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Rows:
    """n sparse rows: column and value of each entry, ordered by row; first[i] is where row i begins."""

    column: np.ndarray
    value: np.ndarray
    first: np.ndarray
    width: int

    @staticmethod
    def of(row: np.ndarray, column: np.ndarray, n: int, width: int, scale: np.ndarray) -> Rows:
        """Counts of the columns of each row, times the row's scale."""
        key, count = np.unique(row.astype(np.int64) * width + column, return_counts=True)
        r = key // width
        return Rows((key % width).astype(np.int64), count * scale[r], np.searchsorted(r, np.arange(n + 1)), width)

    @staticmethod
    def joined(parts: list[Rows]) -> Rows:
        ends = np.cumsum([0, *(len(p.column) for p in parts)])
        first = np.concatenate([*(p.first[:-1] + e for p, e in zip(parts, ends, strict=False)), ends[-1:]])
        return Rows(np.concatenate([p.column for p in parts]), np.concatenate([p.value for p in parts]), first, parts[0].width)

    def take(self, rows: np.ndarray) -> Rows:
        size = self.first[rows + 1] - self.first[rows]
        at = np.repeat(self.first[rows] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        return Rows(self.column[at], self.value[at], np.concatenate([[0], np.cumsum(size)]), self.width)

    def dot(self, w: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0.0], np.cumsum(self.value * w[self.column])])
        return total[self.first[1:]] - total[self.first[:-1]]

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.column, weights=self.value * np.repeat(g, np.diff(self.first)), minlength=self.width)


def descend(gradient, w: np.ndarray, steps: int, rate: float) -> np.ndarray:
    """Adam with a rate that falls to zero."""
    m = v = 0.0
    for i in range(1, steps + 1):
        g = gradient(w)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = w - rate * (1 - (i - 1) / steps) * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.99**i)) + 1e-8)
    return w


def svm(x: Rows, y: np.ndarray, l2: float = 1e-4, steps: int = 60, rate: float = 0.2) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear support vector machine (squared hinge); y is -1 or 1, both classes weigh the same."""
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))

    def gradient(w: np.ndarray) -> np.ndarray:
        slack = np.maximum(0, 1 - y * (x.dot(w[:-1]) + w[-1]))
        g = -2 * y * slack * share
        return np.append(x.back(g), g.sum()) + 2 * l2 * np.append(w[:-1], 0)

    w = descend(gradient, np.zeros(x.width + 1), steps, rate)
    return w[:-1], float(w[-1])


def ordinal(x: Rows, grade: np.ndarray, levels: int, share: np.ndarray | None = None, l2: float = 1e-4, steps: int = 120, rate: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """Shared weights w and rising thresholds t of P(grade <= j) = logistic(t[j] - w x), by penalised likelihood with the rows' shares (alike, if none are given)."""
    share = np.full(len(grade), 1 / len(grade)) if share is None else share
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))

    def thresholds(raw: np.ndarray) -> np.ndarray:
        return np.cumsum(np.append(raw[0], np.exp(raw[1:])))

    def gradient(p: np.ndarray) -> np.ndarray:
        w, raw = p[: x.width], p[x.width :]
        t = np.concatenate([[-np.inf], thresholds(raw), [np.inf]])
        s = x.dot(w)
        up, low = sig(t[grade + 1] - s), sig(t[grade] - s)
        prob = np.maximum(up - low, 1e-9)
        d_up, d_low = up * (1 - up) / prob, low * (1 - low) / prob
        g_t = np.bincount(grade, weights=-d_up * share, minlength=levels)[: levels - 1] + np.bincount(grade, weights=d_low * share, minlength=levels)[1:]
        tail = np.cumsum(g_t[::-1])[::-1]
        return np.concatenate([x.back((d_up - d_low) * share) + 2 * l2 * w, [tail[0]], tail[1:] * np.exp(raw[1:])])

    p = descend(gradient, np.concatenate([np.zeros(x.width), [-1.0], np.zeros(levels - 2)]), steps, rate)
    return p[: x.width], thresholds(p[x.width :])
