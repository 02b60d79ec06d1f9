"""Tail probabilities of the F distribution, for a handful of test statistics on the driver."""

from __future__ import annotations

import math


def f_survival(f: float | None, d1: float, d2: float) -> float | None:
    """P(F > f) with d1 and d2 degrees of freedom."""
    if f is None or d1 <= 0 or d2 <= 0:
        return None
    if f <= 0:
        return 1.0
    if math.isinf(f):
        return 0.0
    return beta_regularized(d2 / (d2 + d1 * f), d2 / 2.0, d1 / 2.0)


def beta_regularized(x: float, a: float, b: float) -> float:
    """I_x(a, b) by its continued fraction (Abramowitz and Stegun 26.5.8), evaluated backwards."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - beta_regularized(1.0 - x, b, a)

    def coefficient(i: int) -> float:
        m = i // 2
        if i % 2:
            return -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        return m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))

    depth, previous = 64, None
    while True:
        tail = 1.0
        for i in range(depth, 0, -1):
            tail = 1.0 + coefficient(i) / tail
        if previous is not None and (abs(tail - previous) <= 1e-13 * abs(tail) or depth > 200_000):
            break
        previous, depth = tail, depth * 2
    log_front = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    return math.exp(log_front) / (a * tail)
