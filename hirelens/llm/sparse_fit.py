"""Follow-the-regularised-leader (proximal, per coordinate) with elastic net."""

from __future__ import annotations

import numpy as np


class Ftrl:
    """Weights of shape ``shape``; rows not touched cost nothing."""

    def __init__(self, shape: tuple[int, ...], alpha: float, l1: float, l2: float, beta: float = 1.0):
        self.z, self.n = np.zeros(shape), np.zeros(shape)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - self.l1, 0.0)
        return -shrunk / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)

    def update(self, at, weights: np.ndarray, gradient: np.ndarray) -> None:
        """``at`` holds distinct rows, ``weights`` what they were for this example."""
        squared = gradient * gradient
        sigma = (np.sqrt(self.n[at] + squared) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += gradient - sigma * weights
        self.n[at] += squared
