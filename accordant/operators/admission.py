"""Row admission: every rule is a column expression, and a row's first broken rule is its ``reject_reason`` (null if none).

Malformed rows are never verdicts: ``admit`` splits them off, and a strict
caller raises on any.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accordant.schema import MAX_SAFE_INTEGER, MODALITIES

#: 1 to 64 characters, alphanumeric at both ends.
IDENTIFIER = "^[A-Za-z0-9]([A-Za-z0-9._:-]{0,62}[A-Za-z0-9])?$"
SYMMETRY_TOLERANCE = 1e-9


def first_broken(rules: list[tuple[str, Column]]) -> Column:
    """The name of the first rule whose condition (of being broken) holds; a null condition counts as broken."""
    out = None
    for name, broken in rules:
        held = F.coalesce(broken, F.lit(True))
        out = F.when(held, name) if out is None else out.when(held, name)
    return out


def finite(x: Column) -> Column:
    return ~F.isnan(x) & (F.abs(x) < float("inf"))


def safe_integer(x: Column, least: int = 0) -> Column:
    return (x >= least) & (x <= MAX_SAFE_INTEGER)


def valid_identifier(x: Column) -> Column:
    return x.rlike(IDENTIFIER)


def scalar_rules(prefix: str = "") -> list[tuple[str, Column]]:
    c = lambda n: F.col(prefix + n)
    return [
        ("track_id_out_of_range", ~safe_integer(c("track_id"))),
        ("timestamp_out_of_range", ~safe_integer(c("timestamp_ms"))),
        ("sequence_out_of_range", ~safe_integer(c("seq"))),
        ("unknown_modality", ~c("modality").isin(*MODALITIES)),
        ("nis_not_finite", ~finite(c("nis"))),
        ("nis_negative", c("nis") < 0),
        ("dof_out_of_range", ~c("dof").between(1, 255)),
    ]


def projection_rules(projection: Column) -> list[tuple[str, Column]]:
    """Only for rows that have a projection."""
    values, dims = projection["values"], projection["dimensions"]
    return [
        ("projection_dimensions", ~dims.between(1, 3)),
        ("projection_size", F.size(values) != 3),
        ("projection_not_finite", ~F.forall(values, finite)),
        ("projection_inactive_axis", F.exists(F.slice(values, dims + 1, F.lit(3)), lambda x: x != 0)),
        ("projection_identity", ~(safe_integer(projection["frame_id"], 1) & safe_integer(projection["context_id"], 1) & safe_integer(projection["prior_id"], 1))),
    ]


def covariance_rules(cov: Column) -> list[tuple[str, Column]]:
    """3 x 3, finite, a positive diagonal, symmetric within tolerance of each pair's scale, and positive definite by leading minors."""
    at = lambda i, j: cov[i][j]
    flat = [at(i, j) for i in range(3) for j in range(3)]
    pairs = [(0, 1), (0, 2), (1, 2)]
    scale = F.greatest(*(F.abs(x) for x in flat))
    a, b, c, d, e, f = (x / scale for x in (at(0, 0), (at(0, 1) + at(1, 0)) / 2, (at(0, 2) + at(2, 0)) / 2, at(1, 1), (at(1, 2) + at(2, 1)) / 2, at(2, 2)))
    minor = a * (d * f - e * e) - b * (b * f - c * e) + c * (b * e - c * d)
    skewed = [F.abs(at(i, j) - at(j, i)) > SYMMETRY_TOLERANCE * F.sqrt(at(i, i)) * F.sqrt(at(j, j)) for i, j in pairs]
    return [
        ("covariance_size", (F.size(cov) != 3) | F.exists(cov, lambda r: F.size(r) != 3)),
        ("covariance_not_finite", ~reduce(lambda x, y: x & y, (finite(x) for x in flat))),
        ("covariance_diagonal", reduce(lambda x, y: x | y, (at(i, i) <= 0 for i in range(3)))),
        ("covariance_not_symmetric", reduce(lambda x, y: x | y, skewed)),
        ("covariance_not_positive_definite", ~((a > 0) & (a * d - b * b > 0) & (minor > 0))),
    ]


def symmetrised(cov: Column) -> Column:
    return F.array(*(F.array(*(cov[i][j] / 2 + cov[j][i] / 2 for j in range(3))) for i in range(3)))


def observation_rules() -> list[tuple[str, Column]]:
    """Scalar rules, then research fields, then the projection, each only where it is there."""
    innovation, cov, projection = F.col("innovation"), F.col("innovation_cov"), F.col("consistency_projection")
    research = innovation.isNotNull() & cov.isNotNull()
    given = lambda there, rules: [(n, F.when(there, F.coalesce(x, F.lit(True))).otherwise(False)) for n, x in rules]
    return [
        *scalar_rules(),
        ("innovation_unpaired", innovation.isNull() != cov.isNull()),
        *given(research, [("innovation_dof", F.col("dof") != 3), ("innovation_size", F.size(innovation) != 3), ("innovation_not_finite", ~F.forall(innovation, finite)), *covariance_rules(cov)]),
        *given(projection.isNotNull(), projection_rules(projection)),
    ]


def admit(rows: DataFrame, rules: list[tuple[str, Column]] | None = None) -> DataFrame:
    """Add ``reject_reason`` and take minus zeros from ``nis``."""
    out = rows.withColumn("reject_reason", first_broken(rules or observation_rules()))
    return out.withColumn("nis", F.col("nis") + F.lit(0.0)) if "nis" in rows.columns else out
