"""Maximum a posteriori estimation in numpy.

Minimises, over k, m, delta, beta and sigma > 0,

    k^2/50 + m^2/50 + sum|delta|/tau + 2 sigma^2 + sum beta^2 / (2 s^2) + W ln sigma + sum w r^2 / (2 sigma^2)

with r = y - (trend (1 + X_m beta) + X_a beta).  Laplace terms are majorised by quadratics that touch them at the current
point, so each step solves a ridge system; sigma has a closed form.  Models that are linear in their parameters need only
the Gram matrix; the others take damped Gauss-Newton steps.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from tidemark.operators import starts

SIGMA_FLOOR = 1e-5
#: Below this a rate change counts as zero in the majoriser.
EDGE = 1e-9
#: Steps between attempts to find the minimum from the signs of the rate changes, and sizes below which these may be zero.
POLISH, SMALL = 10, (1e-6, 1e-5, 1e-4, 1e-3, 1e-2)


@dataclass
class Estimate:
    k: float
    m: float
    delta: np.ndarray
    beta: np.ndarray
    sigma: float
    objective: float
    n_iter: int
    converged: bool


def sigma_of(sse: float, weight: float) -> float:
    """The stationary sigma: 4 s^4 + W s^2 - SSE = 0."""
    return max(float(np.sqrt(2.0 * sse / (weight + np.sqrt(weight**2 + 16.0 * sse)))) if sse > 0 else 0.0, SIGMA_FLOOR)


def objective(theta: np.ndarray, precision: np.ndarray, laplace: np.ndarray, tau: float, sse: float, weight: float, sigma: float) -> float:
    return float(0.5 * (precision * theta**2).sum() + np.abs(theta[laplace]).sum() / tau + 2 * sigma**2 + weight * np.log(sigma) + sse / (2 * sigma**2))


def _solve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    try:
        return np.linalg.solve(a, b)
    except np.linalg.LinAlgError:
        return np.linalg.lstsq(a, b, rcond=None)[0]


def _polished(theta: np.ndarray, gram: np.ndarray, cross: np.ndarray, precision: np.ndarray, laplace: np.ndarray, tau: float, sigma: float, small: float) -> np.ndarray | None:
    """The minimum for this sigma, if the rate changes below ``small`` are zero there and the others keep their signs."""
    sign = np.zeros(len(theta))
    sign[laplace] = np.sign(theta[laplace])
    gone = laplace[np.abs(theta[laplace]) < small]
    kept = np.setdiff1d(np.arange(len(theta)), gone)
    out = np.zeros(len(theta))
    out[kept] = _solve(gram[np.ix_(kept, kept)] / sigma**2 + np.diag(precision[kept]), cross[kept] / sigma**2 - sign[kept] / tau)
    holds = (out * sign >= 0).all() and (np.abs(gram[gone] @ out - cross[gone]) <= sigma**2 / tau).all()
    return out if holds else None


def solve_gram(gram: np.ndarray, cross: np.ndarray, square: float, weight: float, precision: np.ndarray, laplace: np.ndarray, tau: float, start: np.ndarray | None = None, most: int = 500) -> tuple[np.ndarray, float, float, int, bool]:
    """(theta, sigma, objective, steps, converged) of the linear model with these weighted moments."""
    theta = np.zeros(len(cross)) if start is None else start.copy()
    sse_of = lambda th: max(float(square - 2 * th @ cross + th @ gram @ th), 0.0)
    sigma = sigma_of(sse_of(theta), weight)
    last, steps, done = np.inf, 0, False
    for steps in range(1, most + 1):  # noqa: B007
        extra = precision.copy()
        extra[laplace] += 1.0 / (tau * np.maximum(np.abs(theta[laplace]), EDGE if steps > 1 else 0.1))
        theta = _solve(gram / sigma**2 + np.diag(extra), cross / sigma**2)
        sse = sse_of(theta)
        sigma = sigma_of(sse, weight)
        now = objective(theta, precision, laplace, tau, sse, weight, sigma)
        # The majoriser takes small rate changes to zero but slowly; what it comes to is found in one step where it can be told.
        for small in SMALL if steps % POLISH == 0 else ():
            if (trial := _polished(theta, gram, cross, precision, laplace, tau, sigma, small)) is not None:
                then_sse = sse_of(trial)
                then_sigma = sigma_of(then_sse, weight)
                then = objective(trial, precision, laplace, tau, then_sse, weight, then_sigma)
                if then <= now:
                    theta, sigma, now = trial, then_sigma, then
                    break
        if abs(last - now) <= 1e-10 * max(1.0, abs(now)):
            done = True
            break
        last = now
    theta[laplace] = np.where(np.abs(theta[laplace]) < 1e-7, 0.0, theta[laplace])
    return theta, sigma, objective(theta, precision, laplace, tau, sse_of(theta), weight, sigma), steps, done


def hinge(t: np.ndarray, s: np.ndarray) -> np.ndarray:
    return np.maximum(t[:, None] - s[None, :], 0.0)


def gammas(k: float, m: float, delta: np.ndarray, s: np.ndarray) -> np.ndarray:
    out, shift = np.zeros(len(s)), m
    rates = k + np.concatenate([[0.0], np.cumsum(delta)])
    for i in range(len(s)):
        ratio = 0.0 if abs(rates[i + 1]) <= 1e-12 else rates[i] / rates[i + 1]
        out[i] = (s[i] - shift) * (1.0 - ratio)
        shift += out[i]
    return out


def trend(growth: str, t: np.ndarray, cap: np.ndarray | None, k: float, m: float, delta: np.ndarray, s: np.ndarray) -> np.ndarray:
    if growth == "flat":
        return np.full(len(t), m)
    n = np.searchsorted(s, t, side="right")
    if growth == "linear":
        return k * t + m + hinge(t, s) @ delta
    rates = np.concatenate([[k], k + np.cumsum(delta)])
    offsets = np.concatenate([[m], m + np.cumsum(gammas(k, m, delta, s))])
    return cap / (1.0 + np.exp(-np.clip(rates[n] * (t - offsets[n]), -500, 500)))


def linear_start(t: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    span = t[-1] - t[0]
    k = (y[-1] - y[0]) / span if span > 0 else 0.0
    return float(k), float(y[0] - k * t[0])


def logistic_start(t: np.ndarray, y: np.ndarray, cap: np.ndarray) -> tuple[float, float]:
    span = t[-1] - t[0]
    if span <= 0:
        return 0.0, float(y.mean())
    r = [c / max(0.01 * c, min(0.99 * c, v)) for c, v in ((cap[0], y[0]), (cap[-1], y[-1]))]
    if abs(r[0] - r[1]) <= 0.01:
        r[0] *= 1.05
    a, b = np.log(r[0] - 1.0), np.log(r[1] - 1.0)
    return float((a - b) / span), float(a * span / (a - b))


def columns(growth: str, t: np.ndarray, s: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The design matrix of a model that is linear in its parameters."""
    if growth == "flat":
        return np.column_stack([np.zeros_like(t), np.ones_like(t), np.zeros((len(t), len(s))), x])
    return np.column_stack([t, np.ones_like(t), hinge(t, s), x])


def from_moments(gram: np.ndarray, cross: np.ndarray, square: float, weight: float, prior: np.ndarray, n_s: int, tau: float) -> Estimate:
    """The estimate of a model that is linear in its parameters, from its weighted moments."""
    precision = np.concatenate([[1 / 25.0, 1 / 25.0], np.zeros(n_s), 1.0 / np.maximum(prior, 0.01) ** 2])
    theta, sigma, value, steps, done = solve_gram(gram, cross, square, weight, precision, np.arange(2, 2 + n_s), max(tau, 1e-9))
    return Estimate(float(theta[0]), float(theta[1]), theta[2 : 2 + n_s], theta[2 + n_s :], sigma, value, steps, done)


def estimate(growth: str, t: np.ndarray, y: np.ndarray, cap: np.ndarray | None, w: np.ndarray, x: np.ndarray, multiplicative: np.ndarray, prior: np.ndarray, s: np.ndarray, tau: float, most: int = 400) -> Estimate:
    """``x``: features; ``multiplicative``: which of its columns; ``prior``: their scales; ``s``: changepoints, ascending."""
    n_s, n_x = len(s), x.shape[1]
    weight = float(w.sum())
    tau = max(tau, 1e-9)
    beta_precision = 1.0 / np.maximum(prior, 0.01) ** 2
    precision = np.concatenate([[1 / 25.0, 1 / 25.0], np.zeros(n_s), beta_precision])
    laplace = np.arange(2, 2 + n_s)
    if growth != "logistic" and not multiplicative.any():
        design = columns(growth, t, s, x)
        weighted = design * w[:, None]
        return from_moments(design.T @ weighted, weighted.T @ y, float((w * y * y).sum()), weight, prior, n_s, tau)

    if growth == "logistic":
        k0, m0 = logistic_start(t, y, cap)
    else:
        k0, m0 = (0.0, float(y.mean())) if growth == "flat" else linear_start(t, y)
    theta = np.concatenate([[k0, m0], np.zeros(n_s + n_x)])
    free = np.ones(len(theta), bool)
    if growth == "flat":
        free[0], free[laplace] = False, False

    def parts(th: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        beta = th[2 + n_s :]
        return trend(growth, t, cap, th[0], th[1], th[2 : 2 + n_s], s), 1.0 + x[:, multiplicative] @ beta[multiplicative]

    def fitted(th: np.ndarray) -> np.ndarray:
        g, factor = parts(th)
        return g * factor + x[:, ~multiplicative] @ th[2 + n_s :][~multiplicative]

    def jacobian(th: np.ndarray) -> np.ndarray:
        g, factor = parts(th)
        out = np.empty((len(t), len(th)))
        out[:, 2 + n_s :] = np.where(multiplicative[None, :], g[:, None] * x, x)
        if growth == "linear":
            out[:, : 2 + n_s] = np.column_stack([t, np.ones_like(t), hinge(t, s)]) * factor[:, None]
        elif growth == "flat":
            out[:, : 2 + n_s] = 0.0
            out[:, 1] = factor
        else:
            for j in range(2 + n_s):
                step = 1e-6 * max(1.0, abs(th[j]))
                moved = th.copy()
                moved[j] += step
                out[:, j] = (trend(growth, t, cap, moved[0], moved[1], moved[2 : 2 + n_s], s) - g) / step * factor
        return out

    def value(th: np.ndarray) -> tuple[float, float]:
        sse = float((w * (y - fitted(th)) ** 2).sum())
        sigma = sigma_of(sse, weight)
        found = objective(th, precision, laplace, tau, sse, weight, sigma)
        return (found, sigma) if np.isfinite(found) else (np.inf, sigma)

    now, sigma = value(theta)
    if starts.worth_it(len(t), n_s, n_x):
        hot = theta.copy()
        if growth == "linear":
            hot[laplace] = starts.delta(t, y, s, k0)
        rest = y - trend(growth, t, cap, k0, m0, hot[laplace], s)
        scale = np.maximum(np.abs(trend(growth, t, cap, k0, m0, hot[laplace], s)), 1e-3)
        spread = starts.sigma(rest)
        hot[2 + n_s :] = starts.beta(np.where(multiplicative[None, :], scale[:, None] * x, x), rest, spread**2 * beta_precision)
        then, s_then = value(hot)
        if then < now:
            theta, now, sigma = hot, then, s_then
    damping, still, done, steps = 1e-3, 0, False, 0
    for steps in range(1, most + 1):  # noqa: B007
        jac = jacobian(theta)
        extra = precision.copy()
        extra[laplace] += 1.0 / (tau * np.maximum(np.abs(theta[laplace]), EDGE if steps > 5 else 0.05))
        r = y - fitted(theta)
        a = (jac * w[:, None]).T @ jac / sigma**2 + np.diag(extra)
        b = jac.T @ (w * r) / sigma**2 - extra * theta
        a[~free], a[:, ~free], b[~free] = 0.0, 0.0, 0.0
        a[~free, ~free] = 1.0
        moved = False
        for _ in range(12):
            trial = theta + _solve(a + damping * np.diag(np.maximum(np.diag(a), 1e-9)), b)
            then, s_then = value(trial)
            if then <= now + 1e-12 * abs(now):
                gain, theta, now, sigma, moved = now - then, trial, then, s_then, True
                damping = max(damping / 5, 1e-10)
                break
            damping = min(damping * 6, 1e8)
        still = still + 1 if not moved or gain <= 1e-7 * max(1.0, abs(now)) else 0
        if still >= 3:
            done = True
            break
    theta[laplace] = np.where(np.abs(theta[laplace]) < 1e-7, 0.0, theta[laplace])
    return Estimate(float(theta[0]), float(theta[1]), theta[2 : 2 + n_s], theta[2 + n_s :], sigma, value(theta)[0], steps, done)
