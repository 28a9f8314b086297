"""Special functions and intervals, for driver-side constants and small vectors."""

from __future__ import annotations

import functools
import math
from statistics import NormalDist

Z95 = 1.959963984540054
_MASK = (1 << 64) - 1


def normal_quantile(p: float) -> float:
    return NormalDist().inv_cdf(p)


def gamma_q(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function."""
    if not (a > 0 and x >= 0):
        return math.nan
    if x == 0:
        return 1.0
    if math.isinf(x):
        return 0.0
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-17:
            n += 1
            term *= x / n
            total += term
        return 1.0 - total * scale
    # Lentz's continued fraction
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = an * d + b
        d = 1 / (d if abs(d) > tiny else tiny)
        c = b + an / c
        c = c if abs(c) > tiny else tiny
        step = d * c
        h *= step
        if abs(step - 1) < 1e-16:
            break
    return scale * h


def chi2_sf(x: float, k: float) -> float:
    """Right tail of the chi-square distribution."""
    return gamma_q(k / 2, x / 2)


@functools.lru_cache(maxsize=65_536)
def chi2_isf(p: float, k: float) -> float:
    """The x with chi2_sf(x, k) = p."""
    low, high = 0.0, max(1.0, k)
    while chi2_sf(high, k) > p:
        low, high = high, high * 2
    for _ in range(200):
        mid = (low + high) / 2
        if mid in (low, high):
            break
        low, high = (mid, high) if chi2_sf(mid, k) > p else (low, mid)
    return high


def digamma(n: int) -> float:
    """At positive integers, by the harmonic sum."""
    return -0.5772156649015329 + math.fsum(1 / i for i in range(1, n))


def wilson(successes: float, n: float, z: float = Z95) -> tuple[float, float]:
    if n <= 0:
        return 0.0, 1.0
    p = successes / n
    centre = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return max(0.0, centre - half), min(1.0, centre + half)


def hoeffding(mean: float, n: float, low: float, high: float, alpha: float = 0.05) -> tuple[float, float]:
    """For the mean of ``n`` values between ``low`` and ``high``."""
    half = (high - low) * math.sqrt(math.log(2 / alpha) / (2 * n))
    return max(low, mean - half), min(high, mean + half)


def garwood(events: int, exposure: float, alpha: float = 0.05) -> tuple[float, float]:
    """Exact interval of a Poisson rate."""
    low = 0.0 if events == 0 else chi2_isf(1 - alpha / 2, 2 * events) / 2
    return low / exposure, chi2_isf(alpha / 2, 2 * (events + 1)) / 2 / exposure


def envelope(*intervals: tuple[float, float]) -> tuple[float, float]:
    return min(a for a, _ in intervals), max(b for _, b in intervals)


def bartlett_n_eff(n: float, phi: float) -> float:
    return n * (1 - phi * phi) / (1 + phi * phi)


def mix64(x: int) -> int:
    """SplitMix64's finaliser (fixed constants)."""
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & _MASK
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & _MASK
    return x ^ (x >> 31)


def splitmix64(state: int) -> tuple[int, int]:
    """(next state, output)."""
    state = (state + 0x9E3779B97F4A7C15) & _MASK
    return state, mix64(state)


def fnv1a64(data: bytes) -> int:
    h = 0xCBF29CE484222325
    for b in data:
        h = (h ^ b) * 0x100000001B3 & _MASK
    return h


def median(values: list[float]) -> float | None:
    x = sorted(values)
    if not x:
        return None
    m = len(x) // 2
    return x[m] if len(x) % 2 else (x[m - 1] + x[m]) / 2


def nearest_rank(values: list[float], q: float) -> float | None:
    """The smallest value that at least a share q of all don't exceed."""
    x = sorted(values)
    return x[max(0, math.ceil(q * len(x)) - 1)] if x else None


def floor_percentile(values: list[float], q: float) -> float | None:
    x = sorted(values)
    return x[min(len(x) - 1, int(q * (len(x) - 1)))] if x else None


def rounded_quantile(values: list[float], q: float) -> float | None:
    x = sorted(values)
    return x[min(len(x) - 1, int(q * (len(x) - 1) + 0.5))] if x else None
