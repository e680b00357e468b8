"""Shapiro-Wilk W for up to 5000 values, by Royston's approximation (Applied Statistics algorithm R94)."""

from __future__ import annotations

from statistics import NormalDist

import numpy as np


def shapiro_w(values: np.ndarray) -> float:
    x = np.sort(np.asarray(values, float))
    n = len(x)
    if n < 3 or n > 5000:
        raise ValueError("W is defined here for 3 to 5000 values")
    if x[0] == x[-1]:
        return 1.0
    inverse = NormalDist().inv_cdf
    m = np.array([inverse((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    square = float(m @ m)
    if n == 3:
        a = np.array([-np.sqrt(0.5), 0.0, np.sqrt(0.5)])
    else:
        u = 1 / np.sqrt(n)
        # The polynomials of the two outermost weights, from the constant up.
        last = np.polyval([-2.706056, 4.434685, -2.071190, -0.147981, 0.221157, 0.0], u) + m[-1] / np.sqrt(square)
        a = m.copy()
        if n > 5:
            second = np.polyval([-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, 0.0], u) + m[-2] / np.sqrt(square)
            phi = (square - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last**2 - 2 * second**2)
            a /= np.sqrt(phi)
            a[-1], a[-2], a[0], a[1] = last, second, -last, -second
        else:
            phi = (square - 2 * m[-1] ** 2) / (1 - 2 * last**2)
            a /= np.sqrt(phi)
            a[-1], a[0] = last, -last
    centred = x - x.mean()
    return float(min(1.0, (a @ x) ** 2 / (centred @ centred)))
