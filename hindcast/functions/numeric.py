"""Small numeric kernels that run inside tasks; they need no Spark session."""

from __future__ import annotations

from statistics import NormalDist

import numpy as np

_NODES, _WEIGHTS = np.polynomial.legendre.leggauss(240)


def _log_density(t: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of the log-odds of a Beta(a, b) variable, up to a constant."""
    return -a * np.logaddexp(0, -t) - b * np.logaddexp(0, t)


def _window(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Centre, width and ends of what matters of the log-odds."""
    centre, width = np.log(a / b), np.sqrt(1 / a + 1 / b)
    return centre, width, centre - 36 / a - 8 * width, centre + 36 / b + 8 * width


def _mass(low: np.ndarray, end: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integral of the density, scaled to 1 at the centre, from low to end."""
    half = (end - low) / 2
    return half * (_WEIGHTS * np.exp(_log_density(low + half * (_NODES + 1), a, b) - _log_density(np.log(a / b), a, b))).sum(1, keepdims=True)


def _columns(*values) -> list[np.ndarray]:
    return [v.reshape(-1, 1) for v in np.broadcast_arrays(*(np.asarray(v, float) for v in values))]


def beta_cdf(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distribution function of Beta(a, b).

    The log-odds have one smooth hump with exponential tails as their density, so
    Gauss-Legendre quadrature over the part that matters gives it.
    """
    x, a, b = _columns(x, a, b)
    _, _, low, high = _window(a, b)
    inside = np.clip(x, 1e-300, 1 - 1e-16)
    t = np.clip(np.log(inside) - np.log1p(-inside), low, high)
    return np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, _mass(low, t, a, b) / _mass(low, high, a, b)))[:, 0]


def beta_quantile(q: float, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Quantile of Beta(a, b): Newton steps on the log-odds from a normal start."""
    a, b = _columns(a, b)
    centre, width, low, high = _window(a, b)
    goal, top = q * _mass(low, high, a, b), _log_density(centre, a, b)
    t = centre + NormalDist().inv_cdf(q) * width
    for _ in range(12):
        step = (_mass(low, t, a, b) - goal) / np.exp(_log_density(t, a, b) - top)
        t = np.clip(t - np.clip(step, -2 * width, 2 * width), low, high)
    return (1 / (1 + np.exp(-t)))[:, 0]
