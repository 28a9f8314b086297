"""Exact sums of window frames: doubles split into whole-number limbs, limbs summed, and the sum rounded once to a double.

The sum of a window is that of its values' limbs, which are longs, so it has
no error, doesn't depend on the order of rows, and forgets what has left. It
becomes a double by one rounding, half to even; over the largest double it is
that. All in columns of the engine.

A value from 2^-83 to 2^77 (all its bits) has four limbs of 40 bits. Channels
with any other value are summed with limbs for every bit that a double may
have, from the values of each window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bits of a limb: sums of 2^16 limbs, and carries, fit a long.
BITS = 40
LIMB = 1 << BITS
#: Exponents of the units of the four limbs of a mild value, the lowest first.
MILD_UNITS = (-83, -43, -3, 37)
#: Exponents of the units of all limbs that a double may have.
ALL_UNITS = tuple(range(-1074, 1024, BITS))
LARGEST = "1.7976931348623157E308D"


def _power(exponent: int) -> str:
    return f"{2.0**exponent!r}D"


def _scaled(x: str, exponent: str) -> str:
    """``x`` times two to a power, in two steps so that neither power is out of range."""
    return f"({x} * power(2D, floor(({exponent}) / 2D)) * power(2D, ({exponent}) - floor(({exponent}) / 2D)))"


def _floor(x: str) -> str:
    """The whole part of a value that isn't negative, as a double (the engine's floor gives a long)."""
    return f"({x} - {x} % 1D)"


def mild_limbs(value: str) -> dict[str, str]:
    """SQL of the four limbs of a value that is mild, as doubles; the lowest isn't whole if the value isn't mild."""
    out, rest = {}, f"`{value}`"
    for i in range(len(MILD_UNITS) - 1, 0, -1):
        unit = MILD_UNITS[i]
        out[f"_q{i}"] = _floor(f"({rest} * {_power(-unit)})")
        rest = f"({rest} % {_power(unit)})"
    out["_q0"] = f"{rest} * {_power(-MILD_UNITS[0])}"
    return out


def _carried(sums: str) -> str:
    """Limbs, lowest first, of sums of limbs: each under 2^40, with two more for what is carried out."""
    step = f"(a, v) -> named_struct('c', shiftright(v + a.c, {BITS}), 'o', concat(a.o, array((v + a.c) & {LIMB - 1}L)))"
    zero = "named_struct('c', 0L, 'o', CAST(array() AS ARRAY<BIGINT>))"
    return f"aggregate({sums}, {zero}, {step}, a -> concat(a.o, array(a.c & {LIMB - 1}L, shiftright(a.c, {BITS}))))"


def _rounded(rows: DataFrame, limbs: str, lowest: str, out: str, mean: str) -> DataFrame:
    """Add ``out``: the double nearest to the limbs, half to even; ``lowest`` is the exponent of the first limb's unit.

    ``mean`` is the sum by the rows of ``_rows``, also where no double holds the sum.
    """
    top = f"coalesce(array_max(filter(sequence(1, size({limbs})), i -> {limbs}[i - 1] > 0)), 0)"
    at = lambda back: f"IF(_top > {back}, {limbs}[greatest(_top - 1 - {back}, 0)], 0L)"
    steps = (
        {"_top": top},
        # The leading limb, the 62 bits after it, and whether any bit is set beyond those.
        {"_a": at(0), "_l": f"shiftleft({at(1)}, 22) + shiftright({at(2)}, 18)"},
        {"_sticky": f"({at(2)} & {(1 << 18) - 1}L) <> 0 OR exists(slice({limbs}, 1, greatest(_top - 3, 0)), v -> v <> 0)", "_n": "length(bin(_a))"},
        {"_kept": "shiftright(_l, 9 + _n)", "_rest": "_l & (shiftleft(1L, 9 + _n) - 1L)", "_half": "shiftleft(1L, 8 + _n)"},
        {"_up": "_rest > _half OR (_rest = _half AND (_sticky OR (_kept & 1L) = 1L))"},
        {"_m": "CAST(shiftleft(_a, 53 - _n) + _kept + IF(_up, 1L, 0L) AS DOUBLE)", "_e": f"{lowest} + {BITS} * (_top - 1) - (53 - _n)"},
        {out: f"IF(_top = 0, 0D, least({LARGEST}, {_scaled('_m', '_e')}))"},
        {mean: f"IF({out} < 1e300D, {out} / _rows, {_scaled('_m', '_e - 16')} * (65536D / _rows))"},
    )
    for step in steps:
        rows = rows.withColumns({name: F.expr(text) for name, text in step.items()})
    return rows.drop("_top", "_a", "_l", "_sticky", "_n", "_kept", "_rest", "_half", "_up", "_m", "_e")


def _every_limb(values: str) -> str:
    """SQL of the sums of all limbs of a list of doubles."""
    # Of a value v, the limb of unit 2^u: nothing if v lies below it, or has only bits above it.
    y = _scaled("v", "-u")
    limb = f"CAST(IF(v < power(2D, u) OR v * power(2D, -93D) >= power(2D, u), 0D, {_floor(y)} % {float(LIMB)!r}D) AS BIGINT)"
    units = f"array({', '.join(f'{float(u)!r}D' for u in ALL_UNITS)})"
    return f"transform({units}, u -> aggregate({values}, 0L, (a, v) -> a + {limb}))"


def window_sums(rows: DataFrame, value: str, keys: tuple[str, ...], order: str, length: int, out: str = "sum", mean: str = "mean") -> DataFrame:
    """Add ``out``, the exact sum of ``value`` over a key's newest ``length`` rows, rounded once, its ``mean``, and ``limbs`` of mild sums.

    Values must be finite and not negative. ``limbs`` are four whole numbers
    and two of what is carried out, lowest first; null for channels with a value
    that isn't mild. Values of 0 add nothing; an empty table gives no rows.
    """
    if not 1 <= length <= 1 << 16:
        raise ValueError("windows have 1 to 65536 rows")
    whole = Window.partitionBy(*keys)
    own = whole.orderBy(order).rowsBetween(-(length - 1), 0)
    split = rows.withColumns({name: F.expr(text) for name, text in mild_limbs(value).items()})
    wild = F.expr(f"`{value}` >= {_power(77)} OR _q0 % 1D > 0D")
    longs = {f"_s{i}": F.sum(F.when(~wild, F.col(f"_q{i}")).otherwise(0.0).cast("long")).over(own) for i in range(len(MILD_UNITS))}
    judged = split.withColumns(longs | {"_wild": F.max(wild).over(whole), "_rows": F.count(F.lit(1)).over(own)})
    held = judged.withColumn("_list", F.collect_list(F.when(F.col("_wild"), F.col(value))).over(own))
    mild = F.expr(_carried(f"array({', '.join(f'_s{i}' for i in range(len(MILD_UNITS)))})"))
    every = F.expr(_carried(_every_limb("_list")))
    both = held.withColumn("_limbs", F.when(F.col("_wild"), every).otherwise(mild))
    lowest = f"IF(_wild, {ALL_UNITS[0]}, {MILD_UNITS[0]})"
    told = _rounded(both, "_limbs", lowest, out, mean).withColumn("limbs", F.when(~F.col("_wild"), F.col("_limbs")))
    return told.drop(*(f"_q{i}" for i in range(4)), *longs, "_wild", "_rows", "_list", "_limbs")


def limb_columns(limbs: Column) -> dict[str, Column]:
    """The limbs of a mild sum as columns limb_0 to limb_4."""
    return {f"limb_{i}": limbs[i] for i in range(len(MILD_UNITS) + 1)}
