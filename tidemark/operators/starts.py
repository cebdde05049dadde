"""Starting values from the data for models that are not linear in their parameters.

A start only saves steps or finds a better basin: the solver takes it where the objective is lower there than at the plain
one, and only for series long enough to carry it.
"""

from __future__ import annotations

import numpy as np

#: Bounds of sigma's start and of a feature's, and share and least size of a rate change.
SIGMA_BOUNDS, MOST_BETA, MOST_DELTA = (0.01, 10.0), 2.0, (0.5, 0.1)
#: Rows on either side of a changepoint (a share of the series, within bounds).
WINDOW_SHARE, WINDOW = 20, (3, 50)


def worth_it(n: int, n_changepoints: int, n_features: int) -> bool:
    """Fixed rule: ten rows a changepoint and twenty a feature, a hundred in all."""
    return n >= max(10 * n_changepoints + 20 * n_features, 100)


def window(n: int) -> int:
    return min(max(n // WINDOW_SHARE, WINDOW[0]), WINDOW[1])


def delta(t: np.ndarray, y: np.ndarray, s: np.ndarray, k: float) -> np.ndarray:
    """Slope after each changepoint less the slope before it, bounded by a share of the overall slope."""
    n, w, most = len(t), window(len(t)), MOST_DELTA[0] * abs(k) + MOST_DELTA[1]
    out = np.zeros(len(s))
    for j, at in enumerate(np.searchsorted(t, s, side="left")):
        if 0 < at < n - 1:
            ends = (at, min(at + w, n) - 1), (max(at - w, 0), at - 1)
            slopes = [(y[b] - y[a]) / (t[b] - t[a]) if t[b] > t[a] else 0.0 for a, b in ends]
            out[j] = np.clip(slopes[0] - slopes[1], -most, most)
    return out


def beta(x: np.ndarray, residual: np.ndarray, precision: np.ndarray) -> np.ndarray:
    """Ridge regression of what the trend leaves."""
    if not x.shape[1]:
        return np.zeros(0)
    return np.clip(np.linalg.lstsq(x.T @ x + np.diag(precision), x.T @ residual, rcond=None)[0], -MOST_BETA, MOST_BETA)


def sigma(residual: np.ndarray) -> float:
    return float(np.clip(residual.std(), *SIGMA_BOUNDS))
