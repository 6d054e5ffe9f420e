"""Tail probabilities for coefficient and fit tables; a handful of scalars per model."""

from __future__ import annotations

import math
from collections.abc import Callable
from statistics import NormalDist


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function, evaluated by Lentz's method until it no
    longer changes; that takes some sqrt(max(a, b)) terms."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    value = d
    limit = 1000 + 20 * math.isqrt(int(max(a, b)) + 1)
    for m in range(1, limit):
        for term in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + term * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + term / c
            c = c if abs(c) > tiny else tiny
            step = c * d
            value *= step
        if abs(step - 1.0) < 1e-15:
            return value
    raise ArithmeticError(f"the incomplete beta function at ({a}, {b}, {x}) does not converge")


def _log_gamma_ratio(a: float, b: float) -> float:
    """log(gamma(a + b) / gamma(a)). For large ``a`` the difference of Stirling's series, term by
    term: the logarithms themselves are too large to be subtracted."""
    if a < 50.0:
        return math.lgamma(a + b) - math.lgamma(a)
    c = a + b

    def rest(x: float) -> float:
        return 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5) - 1 / (1680 * x**7)

    return (a - 0.5) * math.log1p(b / a) + b * math.log(c) - b + rest(c) - rest(a)


def beta_cdf(x: float, y: float, a: float, b: float) -> float:
    """Regularised incomplete beta function at ``x``; ``y`` is 1 - x, passed apart because
    with millions of degrees of freedom one of the two is too near 1 to be subtracted."""
    if x <= 0.0:
        return 0.0
    if y <= 0.0:
        return 1.0
    log_x = math.log1p(-y) if y < 0.5 else math.log(x)
    log_y = math.log1p(-x) if x < 0.5 else math.log(y)
    large, small = max(a, b), min(a, b)
    log_beta = math.lgamma(small) - _log_gamma_ratio(large, small)
    front = math.exp(a * log_x + b * log_y - log_beta)
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, y) / b


_EXACT = 1e6


def _by_degrees(tail: Callable[[float], float], df: float) -> float:
    """``tail(df)``. A tail is a power series in 1 / df; beyond a million degrees of freedom, where
    the fraction's argument is too near 1 for double precision, its first two terms are
    exact to 1e-12, and two values give them."""
    if df <= _EXACT:
        return tail(df)
    far, near = tail(_EXACT), tail(_EXACT / 2)
    return far + (near - far) * (_EXACT / df - 1.0)


def t_two_sided(t: float, df: float) -> float:
    """P(|T| >= |t|)."""
    return _by_degrees(
        lambda d: beta_cdf(d / (d + t * t), t * t / (d + t * t), d / 2.0, 0.5), df
    )


def f_upper(f: float, df1: float, df2: float) -> float:
    """P(F >= f)."""
    if f <= 0.0:
        return 1.0
    return _by_degrees(
        lambda d: beta_cdf(d / (d + df1 * f), df1 * f / (d + df1 * f), d / 2.0, df1 / 2.0), df2
    )


def chi2_upper_2df(x: float) -> float:
    return math.exp(-x / 2.0)


def t_quantile(p: float, df: float) -> float:
    """Upper quantile for ``p`` > 0.5: Newton's method on the two-sided tail, kept inside a bracket."""
    target = 2.0 * (1.0 - p)
    lo, hi = 0.0, 1.0
    while t_two_sided(hi, df) > target:
        lo, hi = hi, 2.0 * hi
    log_scale = _log_gamma_ratio(df / 2, 0.5) - math.log(df * math.pi) / 2
    t = (lo + hi) / 2.0
    while True:
        gap = t_two_sided(t, df) - target
        lo, hi = (t, hi) if gap > 0 else (lo, t)
        density = math.exp(log_scale - (df + 1) / 2 * math.log1p(t * t / df))
        new = t + gap / (2.0 * density)
        if not lo < new < hi:
            new = (lo + hi) / 2.0
        if new in (lo, hi) or abs(new - t) <= 1e-15 * t:
            return new
        t = new


def normal_quantile(p: float) -> float:
    return NormalDist().inv_cdf(p)
