"""Attack and manoeuvre injections as row transforms of observations with columns y0..y2, c00..c22 (a covariance's upper part) and p0..p2.

Each returns a new DataFrame, so an injection that raises changes nothing.
NIS is the Mahalanobis form by a Cholesky factor of the scaled covariance.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Injection(Protocol):
    def __call__(self, rows: DataFrame) -> DataFrame: ...


def mahalanobis(y: list[Column], c00: Column, c01: Column, c02: Column, c11: Column, c12: Column, c22: Column) -> Column:
    """Null where the covariance isn't positive definite."""
    scale = F.greatest(*(F.abs(x) for x in (c00, c01, c02, c11, c12, c22)))
    a00, a10, a20, a11, a21, a22 = (x / scale for x in (c00, c01, c02, c11, c12, c22))
    root = F.sqrt(scale)
    l00 = F.sqrt(a00)
    l10, l20 = a10 / l00, a20 / l00
    pivot1 = a11 - l10 * l10
    l11 = F.sqrt(pivot1)
    l21 = (a21 - l20 * l10) / l11
    pivot2 = a22 - l20 * l20 - l21 * l21
    z0 = y[0] / root / l00
    z1 = (y[1] / root - l10 * z0) / l11
    z2 = (y[2] / root - l20 * z0 - l21 * z1) / F.sqrt(pivot2)
    return F.when((a00 > 0) & (pivot1 > 0) & (pivot2 > 0), z0 * z0 + z1 * z1 + z2 * z2)


COVARIANCE = ("c00", "c01", "c02", "c11", "c12", "c22")


def renewed(rows: DataFrame, y: list[Column], p: list[Column]) -> DataFrame:
    """Rows with new innovations, projections and the NIS that goes with them."""
    out = rows.withColumns({f"y{i}": x for i, x in enumerate(y)} | {f"p{i}": x for i, x in enumerate(p)})
    return out.withColumn("nis", mahalanobis([F.col(f"y{i}") for i in range(3)], *(F.col(c) for c in COVARIANCE)))


def _shifted(rows: DataFrame, delta: Column) -> DataFrame:
    return renewed(rows, [F.col("y0") + delta, F.col("y1"), F.col("y2")], [F.col("p0") + delta, F.col("p1"), F.col("p2")])


@dataclass(frozen=True)
class Phantom:
    """A direction-of-arrival bias on one channel, in standard deviations of its first axis."""

    target: str
    start: int
    bias: float

    def __call__(self, rows: DataFrame) -> DataFrame:
        hit = (F.col("modality") == self.target) & (F.col("seq") >= self.start)
        return _shifted(rows, F.when(hit, self.bias * F.sqrt("c00")).otherwise(0.0))


@dataclass(frozen=True)
class Jam:
    """All residuals of all channels grow by a factor."""

    start: int
    inflation: float

    def __post_init__(self) -> None:
        if not 1 < self.inflation < 1e150:
            raise ValueError("inflation is finite and over 1")

    def __call__(self, rows: DataFrame) -> DataFrame:
        factor = F.when(F.col("seq") >= self.start, self.inflation).otherwise(1.0)
        return renewed(rows, [F.col(f"y{i}") * factor for i in range(3)], [F.col(f"p{i}") * factor for i in range(3)])


@dataclass(frozen=True)
class Maneuver:
    """A triangular disturbance of ``duration`` frames that reaches each channel ``lag_step`` frames a code later."""

    start: int
    duration: int
    magnitude: float
    lag_step: int = 0

    def __post_init__(self) -> None:
        if self.duration == 1 or self.duration < 0:
            raise ValueError("a manoeuvre lasts 0 frames or at least 2")

    def profile(self) -> Column:
        if not self.duration:
            return F.lit(0.0)
        offset = F.col("seq") - self.start - F.col("code") * self.lag_step
        d = float(self.duration)
        shape = 1 - F.abs(2 * offset / d - 1) if self.duration % 2 == 0 else 1 - (d - 2 * F.least(offset, d - offset)) / d
        return F.when((offset >= 0) & (offset < self.duration), self.magnitude * shape).otherwise(0.0)

    def __call__(self, rows: DataFrame) -> DataFrame:
        return _shifted(rows, self.profile() * F.sqrt("c00"))


def inject(rows: DataFrame, injection: Injection) -> DataFrame:
    return rows.transform(injection)
