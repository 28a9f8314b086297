"""What a recorded stream will cost, told by one grouping before any of it is assessed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accordant.operators.admission import first_broken

#: Ceilings of a study on one recorded stream.
MOST_ASSESSMENTS, MOST_PRODUCTS, MOST_RESETS = 2_000_000, 500_000_000, 1_000_000


def track_work(rows: DataFrame, step: int, window: int, axes: int = 3) -> DataFrame:
    """One row a track: frames, channels, assessments (of two detectors), products of pairs of samples and resets at most.

    Rows without a sequence are no frame; channels are told over the rows of
    frames. Frames are counted where their rows meet, then by track, so a track
    is never in one task as rows.
    """
    if step < 1 or window < 1:
        raise ValueError("step and window are at least 1")
    frames = rows.filter(F.col("seq").isNotNull()).groupBy("track_id", "seq").agg(F.collect_set("modality").alias("seen"))
    # A set of the few channels that there are: as many as the modalities.
    tracks = frames.groupBy("track_id").agg(F.count("*").alias("frames"), F.size(F.array_distinct(F.flatten(F.collect_set("seen")))).cast("long").alias("channels"))
    assessments = F.ceil(F.col("frames") / step)
    pairs = F.expr("channels * (channels - 1) div 2")
    return tracks.select(
        "track_id", "frames", "channels", (assessments * 2).alias("assessments"),
        (assessments * axes * pairs * F.least(F.lit(window).cast("long"), F.col("frames"))).alias("products"), (F.col("frames") - 1).alias("resets"),
    )


def work(rows: DataFrame, step: int, window: int, axes: int = 3) -> DataFrame:
    """One row: the sums over all tracks (0 without one), and the first ceiling that they break, if any."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    told = track_work(rows, step, window, axes).agg(F.count("*").alias("tracks"), *map(total, ("frames", "assessments", "products", "resets")))
    fault = first_broken(
        [
            ("no_observations", F.col("tracks") == 0),
            ("too_many_assessments", F.col("assessments") > MOST_ASSESSMENTS),
            ("too_many_products", F.col("products") > MOST_PRODUCTS),
            ("too_many_resets", F.col("resets") > MOST_RESETS),
        ]
    )
    return told.withColumn("fault", fault)
