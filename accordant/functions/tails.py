"""Tail probabilities as columns of the engine, by sums of known length; ``special`` has the same for the driver."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Terms of the series, and of the continued fraction, of the complementary error function; either is exact to 1e-15 on its side of 4.
TERMS, SIDE = 64, 4.0


def _error_complement(h: str) -> str:
    """SQL of erfc(sqrt(h))."""
    z = f"sqrt({h})"
    series = (
        f"1D - {2 / math.sqrt(math.pi)!r}D * exp(-({h})) * aggregate(sequence(1, {TERMS}), named_struct('t', {z}, 's', {z}), "
        f"(a, n) -> named_struct('t', a.t * 2D * {h} / (2D * n + 1D), 's', a.s + a.t * 2D * {h} / (2D * n + 1D)), a -> a.s)"
    )
    fraction = f"exp(-({h})) / ({math.sqrt(math.pi)!r}D * aggregate(sequence({TERMS}, 1, -1), {z}, (a, j) -> {z} + (j / 2D) / a))"
    return f"IF({h} < {SIDE!r}D, {series}, {fraction})"


def chi2_right(x: str, k: str) -> Column:
    """The right tail of the chi-square distribution with ``k`` degrees of freedom (a whole number) at ``x``, both columns by name.

    The tail is a finite sum: for even degrees of Poisson terms, for odd ones
    of half-whole ones on top of the complementary error function. Terms are
    taken from their logarithms, so only what no double holds becomes 0. The
    tail at 0 is 1 and at infinity 0; null for nulls, negative values, NaN and
    less than one degree.
    """
    h, half = f"(`{x}` / 2D)", f"((`{k}` % 2) / 2D)"
    first = f"-{h} + IF(`{k}` % 2 = 1, 0.5D * ln({h}) - {math.lgamma(1.5)!r}D, 0D)"
    start = f"named_struct('l', {first}, 's', 0D)"
    step = f"(a, i) -> named_struct('l', a.l + ln({h} / (i + 1D + {half})), 's', a.s + exp(a.l))"
    terms = f"IF(`{k}` >= 2, aggregate(sequence(0, CAST(`{k}` DIV 2 AS INT) - 1), {start}, {step}, a -> a.s), 0D)"
    base = f"IF(`{k}` % 2 = 1, {_error_complement(h)}, 0D)"
    inside = f"least(1D, {terms} + {base})"
    return F.expr(
        f"CASE WHEN `{k}` >= 1 AND `{x}` = 0 THEN 1D WHEN `{k}` >= 1 AND `{x}` = double('infinity') THEN 0D"
        f" WHEN `{k}` >= 1 AND `{x}` > 0 AND NOT isnan(`{x}`) THEN {inside} END"
    )
