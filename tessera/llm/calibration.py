"""Isotonic calibration: pool adjacent violators, applied by interpolation between a bounded number of knots."""

from __future__ import annotations

import numpy as np


def isotonic(scores: np.ndarray, labels: np.ndarray, knots: int = 200) -> tuple[list[float], list[float]]:
    """Knots (score, probability), both increasing. One class or no rows: a constant."""
    if not len(scores):
        return [0.0], [0.0]
    values, at = np.unique(np.asarray(scores, float), return_inverse=True)
    weight, total = np.bincount(at).astype(float), np.bincount(at, weights=np.asarray(labels, float))
    blocks: list[list[float]] = []  # weight, sum, first and last score
    for v, w, t in zip(values, weight, total):
        blocks.append([w, t, v, v])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            w2, t2, _, last = blocks.pop()
            blocks[-1][0] += w2
            blocks[-1][1] += t2
            blocks[-1][3] = last
    xs, ys = [], []
    for w, t, first, last in blocks:
        for x in dict.fromkeys((first, last)):
            xs.append(float(x))
            ys.append(float(t / w))
    if len(xs) > knots:
        keep = np.unique(np.linspace(0, len(xs) - 1, knots).astype(int))
        xs, ys = [xs[k] for k in keep], [ys[k] for k in keep]
    return xs, ys


def apply(model: tuple[list[float], list[float]], scores: np.ndarray) -> np.ndarray:
    return np.clip(np.interp(scores, model[0], model[1]), 0.0, 1.0)
