"""A small logistic regression, fitted on the driver over a bounded sample of labelled feature rows."""

from __future__ import annotations

import numpy as np


def fit(features: np.ndarray, labels: np.ndarray, ridge: float = 1.0, rounds: int = 40, rising: list[bool] | None = None) -> np.ndarray:
    """Ridge-penalised weights by Newton steps; the first column is the intercept and is not penalised. Columns that are `rising` get no negative weight: the most negative leaves."""
    if rising is not None:
        held = np.ones(features.shape[1], bool)
        while True:
            weights = np.zeros(features.shape[1])
            weights[held] = fit(features[:, held], labels, ridge, rounds)
            wrong = np.where(rising, weights, 0.0)
            if wrong.min() >= 0:
                return weights
            held[wrong.argmin()] = False
    weights = np.zeros(features.shape[1])
    penalty = np.full(features.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(rounds):
        p = sigmoid(features @ weights)
        slope = features.T @ (labels - p) - penalty * weights
        curve = (features * (p * (1 - p))[:, None]).T @ features + np.diag(penalty)
        step = np.linalg.solve(curve, slope)
        weights += step * min(1.0, 4.0 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-7:
            break
    return weights


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))
