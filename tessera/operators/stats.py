"""Numerics that no installed library has."""

from __future__ import annotations

import math

import numpy as np


def beta_tail(x: float, a: float, b: float) -> float:
    """The regularised incomplete beta function I_x(a, b), by its continued fraction (Lentz)."""
    if x <= 0 or a <= 0:
        return 0.0
    if x >= 1 or b <= 0:
        return 1.0
    front = math.exp(max(-745.0, math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)))
    if x > (a + 1) / (a + b + 2):
        return 1.0 - front * _fraction(1 - x, b, a) / b
    return front * _fraction(x, a, b) / a


def _fraction(x: float, a: float, b: float) -> float:
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 500):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + step * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + step / c
            c = c if abs(c) > tiny else tiny
            out *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return out


def assignment(cost: np.ndarray) -> list[int]:
    """For each row its column in an assignment of least total cost (Hungarian algorithm, rows <= columns)."""
    n, m = cost.shape
    if n > m:
        raise ValueError("more rows than columns")
    u, v, match = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        match[0], j = i, 0
        least, way, used = np.full(m + 1, np.inf), np.zeros(m + 1, int), np.zeros(m + 1, bool)
        while True:
            used[j] = True
            free = ~used[1:]
            slack = cost[match[j] - 1] - u[match[j]] - v[1:]
            better = free & (slack < least[1:])
            least[1:][better], way[1:][better] = slack[better], j
            k = 1 + int(np.argmin(np.where(free, least[1:], np.inf)))
            delta = least[k]
            u[match[used]] += delta
            v[used] -= delta
            least[~used] -= delta
            j = k
            if not match[j]:
                break
        while j:
            match[j], j = match[way[j]], way[j]
    out = [0] * n
    for j in range(1, m + 1):
        if match[j]:
            out[match[j] - 1] = j - 1
    return out
