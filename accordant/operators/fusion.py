"""Fusion of magnitude and consistency evidence into one verdict a frame, as column expressions over a few columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from accordant.config import CorrelationConfig, DetectorConfig
from accordant.operators import correlation, magnitude, ordering
from accordant.schema import canonical

PROVENANCE = ("p0", "p1", "p2", "frame_id", "context_id", "prior_id")


def names_of(mask: Column, modalities: tuple[str, ...]) -> Column:
    return magnitude.labels({m: mask.bitwiseAND(F.lit(1 << i)) != 0 for i, m in enumerate(canonical(modalities))})


def mask_of(names: Column, modalities: tuple[str, ...]) -> Column:
    has = F.split(names, ",")
    return sum((F.when(F.array_contains(has, m), 1 << i).otherwise(0) for i, m in enumerate(canonical(modalities))), F.lit(0))


def axis_evidence(rows: DataFrame, axes: int = 3) -> DataFrame:
    """Add ``consistency`` (intact, decoupled, insufficient, conflicted) and ``consistency_mask`` from corr_<axis> and mask_<axis>.

    Axes that attribute different channels conflict, and so does an
    attribution beside an axis without evidence. Without a column of ``status``
    an error on any axis leaves no evidence at all.
    """
    states, masks = [F.col(f"corr_{a}") for a in range(axes)], [F.col(f"mask_{a}") for a in range(axes)]
    error = correlation._any([s == "error" for s in states])
    insufficient = correlation._any([s == "insufficient" for s in states])
    union = masks[0]
    for m in masks[1:]:
        union = union.bitwiseOR(m)
    differs = correlation._any([(s == "decoupled") & (m != union) for s, m in zip(states, masks, strict=True)])
    state = F.when(error, "insufficient").when((union != 0) & (differs | insufficient), "conflicted").when(insufficient, "insufficient").when(union == 0, "intact").otherwise("decoupled")
    return rows.withColumn("consistency", state).withColumn("consistency_mask", F.when(F.col("consistency").isin("decoupled", "conflicted"), union).otherwise(0))


def combine(rows: DataFrame) -> DataFrame:
    """Add fused_verdict, fused_mask and fused_magnitude from magnitude_verdict, magnitude_mask, consistency and consistency_mask.

    The first rule that applies decides, in this order: conflicting
    consistency; unclassified magnitude; no evidence of either kind; a
    decoupling that agrees or disagrees with what magnitude attributes; then
    magnitude alone, which needs consistency only to be nominal.
    """
    v, own, c, dec = (F.col(x) for x in ("magnitude_verdict", "magnitude_mask", "consistency", "consistency_mask"))
    both = own.bitwiseOR(dec)
    missing = v == "insufficient"
    disagree = v.isin("attributed", "broad") & (own != dec)
    decoupled = c == "decoupled"
    verdict = (
        F.when(c == "conflicted", "unclassified")
        .when(v == "unclassified", "unclassified")
        .when(missing & (c == "insufficient"), "insufficient")
        .when(decoupled & disagree, "unclassified")
        .when(decoupled, "attributed")
        .when(v == "broad", "broad")
        .when(v == "attributed", "attributed")
        .when((v == "nominal") & (c == "insufficient"), "insufficient")
        .when(v == "nominal", "nominal")
        .otherwise("insufficient")
    )
    out = rows.withColumn("fused_verdict", verdict)
    named = F.col("fused_verdict").isin("unclassified", "attributed")
    shared = both.bitwiseAND(own)
    kind = F.when(~decoupled, "elevated").when(missing, "insufficient").when(shared == 0, "in_covariance").when(shared == both, "elevated").otherwise("mixed")
    return out.withColumn("fused_mask", F.when(named, F.when(decoupled | (c == "conflicted"), both).otherwise(own)).otherwise(0)).withColumn("fused_magnitude", F.when(F.col("fused_verdict") == "attributed", kind))


def assessed_frames(rows: DataFrame, modalities: tuple[str, ...], detector: DetectorConfig | None = None, corr: CorrelationConfig | None = None, axes: int = 3) -> DataFrame:
    """The whole rolling assessment: one row a (track_id, seq) with every intermediate state.

    All exchanges are by track_id; all windows and groups have keys that begin
    with it. Rejected rows are no evidence. From the frame on in which a prior
    is used again, a track has no consistency evidence (``extraction_error``).
    """
    mods = canonical(modalities)
    detector, corr = detector or DetectorConfig(), (corr or CorrelationConfig()).for_axes(axes)
    checked = correlation.with_reuse(ordering.checked(rows, detector, mods))
    sound = checked.filter(F.col("reject").isNull())
    reports = magnitude.channel_reports(magnitude.channel_windows(sound, detector), detector, len(mods))
    wide = magnitude.frames(reports, mods, PROVENANCE, ("is_reset", "reused"))
    judged = magnitude.magnitude_verdict(wide, detector, mods).withColumn("magnitude_mask", mask_of(F.col("magnitude_channels"), mods))
    analysed = correlation.consensus(correlation.pair_correlations(correlation.aligned(judged, detector, mods), corr, mods, axes), corr, mods, axes)
    evidence = axis_evidence(analysed, axes)
    # A frame with broken projections spoils every window that holds it.
    by = Window.partitionBy("track_id", "generation").orderBy("seq")
    row = F.row_number().over(by)
    spoilt = evidence.withColumn("_row", row).withColumn("_bad", F.max(F.when(F.col("partial"), F.col("_row"))).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    extraction_error = F.col("reused") | F.coalesce(F.col("_row") - F.col("_bad") < corr.window, F.lit(False))
    some_error = correlation._any([F.col(f"corr_{a}") == "error" for a in range(axes)])
    some_missing = correlation._any([F.col(f"corr_{a}") == "insufficient" for a in range(axes)])
    status = (
        F.when(F.lit(len(mods) < detector.min_channels), "too_few_modalities").when(extraction_error, "extraction_error").when(F.col("place").isNull(), "missing_projection")
        .when(some_error, "analysis_error").when(some_missing, "assessed_insufficient").otherwise("assessed")
    )
    told = spoilt.withColumn("consistency_status", status)
    unknown = F.col("consistency_status").isin("too_few_modalities", "extraction_error", "missing_projection", "analysis_error")
    told = told.withColumn("consistency", F.when(unknown, "insufficient").otherwise(F.col("consistency"))).withColumn("consistency_mask", F.when(unknown, 0).otherwise(F.col("consistency_mask")))
    return combine(told).drop("_row", "_bad").withColumn("fused_channels", names_of(F.col("fused_mask"), mods))
