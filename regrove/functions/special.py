"""Vectorised log-gamma and its derivatives for Arrow batches."""

from __future__ import annotations

import numpy as np

_SHIFT = 8  # series is accurate to machine precision beyond this


def log_gamma(x):
    x = np.asarray(x, dtype=float)
    prod = np.ones_like(x)
    for k in range(_SHIFT):
        prod = prod * (x + k)
    z = x + _SHIFT
    r = 1.0 / (z * z)
    tail = (1.0 / 12 - r * (1.0 / 360 - r * (1.0 / 1260 - r / 1680))) / z
    return (z - 0.5) * np.log(z) - z + 0.5 * np.log(2 * np.pi) + tail - np.log(prod)


def digamma(x):
    x = np.asarray(x, dtype=float)
    down = sum(1.0 / (x + k) for k in range(_SHIFT))
    z = x + _SHIFT
    r = 1.0 / (z * z)
    return np.log(z) - 0.5 / z - r * (1.0 / 12 - r * (1.0 / 120 - r * (1.0 / 252 - r / 240))) - down


def trigamma(x):
    x = np.asarray(x, dtype=float)
    down = sum(1.0 / (x + k) ** 2 for k in range(_SHIFT))
    z = x + _SHIFT
    r = 1.0 / (z * z)
    return (1.0 + 0.5 / z + r * (1.0 / 6 - r * (1.0 / 30 - r * (1.0 / 42 - r * (1.0 / 30 - r * 5.0 / 66))))) / z + down
