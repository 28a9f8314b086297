"""Observations: one row for each (track, modality, sequence)."""

from __future__ import annotations

from pyspark.sql import types as T

#: Modalities in order of their stable codes (fixed values).
MODALITIES = ("visual", "thermal", "acoustic", "radar", "lidar", "radiofrequency")
CODES = {m: i for i, m in enumerate(MODALITIES)}
#: The largest integer that JSON keeps exactly.
MAX_SAFE_INTEGER = 2**53 - 1

PROJECTION = T.StructType(
    [
        T.StructField("values", T.ArrayType(T.DoubleType())),
        T.StructField("dimensions", T.IntegerType()),
        T.StructField("frame_id", T.LongType()),
        T.StructField("context_id", T.LongType()),
        T.StructField("prior_id", T.LongType()),
    ]
)

OBSERVATION = T.StructType(
    [
        T.StructField("track_id", T.LongType()),
        T.StructField("timestamp_ms", T.LongType()),
        T.StructField("seq", T.LongType()),
        T.StructField("modality", T.StringType()),
        T.StructField("nis", T.DoubleType()),
        T.StructField("dof", T.IntegerType()),
        T.StructField("innovation", T.ArrayType(T.DoubleType())),
        T.StructField("innovation_cov", T.ArrayType(T.ArrayType(T.DoubleType()))),
        T.StructField("consistency_projection", PROJECTION),
    ]
)


def canonical(modalities: tuple[str, ...]) -> tuple[str, ...]:
    """Distinct modalities in order of code; an unknown one raises ValueError."""
    unknown = [m for m in modalities if m not in CODES]
    if unknown:
        raise ValueError(f"unknown modalities {unknown}")
    return tuple(sorted(set(modalities), key=CODES.__getitem__))
