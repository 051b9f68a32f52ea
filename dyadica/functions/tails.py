"""Distribution tails for the handful of result scalars a report ends with."""

from __future__ import annotations

import math
from functools import cache
from statistics import NormalDist


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    value = d
    for m in range(1, 500):
        for numerator in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                          -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + numerator * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + numerator / c
            c = c if abs(c) > tiny else tiny
            value *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return value


def incomplete_beta(a: float, b: float, x: float) -> float:
    if x <= 0.0 or x >= 1.0:
        return 0.0 if x <= 0.0 else 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
                     + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def t_two_sided(t: float, df: float) -> float:
    """P(|T| >= |t|) for Student's t."""
    if math.isinf(t):
        return 0.0
    return incomplete_beta(df / 2.0, 0.5, df / (df + t * t))


@cache
def t_quantile(p: float, df: float) -> float:
    """Upper quantile for p >= 0.5, by bisection on the tail."""
    if p < 0.5:
        return -t_quantile(1.0 - p, df)
    low, high = 0.0, 1.0
    while t_two_sided(high, df) > 2.0 * (1.0 - p):
        high *= 2.0
    for _ in range(200):
        mid = (low + high) / 2.0
        if t_two_sided(mid, df) > 2.0 * (1.0 - p):
            low = mid
        else:
            high = mid
    return (low + high) / 2.0


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2.0))


def wide_t_quantile(p: float, df):
    """The quantile for 30 and more degrees of freedom, right to seven digits; ``df`` may be a column.

    Expansion around the normal quantile z in powers of 1 / df.
    """
    z = NormalDist().inv_cdf(p)
    # Coefficients of the powers of z, highest first, with the divisor of each order.
    orders = [([1, 1], 4), ([5, 16, 3], 96), ([3, 19, 17, -15], 384), ([79, 776, 1482, -1920, -945], 92160)]
    out = z
    for k, (coefficients, divisor) in enumerate(orders, 1):
        top = 2 * len(coefficients) - 1
        value = sum(c * z ** (top - 2 * i) for i, c in enumerate(coefficients)) / divisor
        out = out + value / df ** k
    return out
