"""Magnitude detector: per-channel chi-square windows, two-sided CUSUM, and the verdict of a frame.

Everything is keyed by a prefix of (track_id, ...): one exchange on ``track_id``
for the pass over sorted rows (``ordering``), one for all windows and groups.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from accordant.config import DetectorConfig
from accordant.functions.special import chi2_isf
from accordant.operators import exact, ordering
from accordant.schema import canonical

KEY = ("track_id", "generation", "modality")


def critical_values(cfg: DetectorConfig, channels: int, dof: int) -> list[float]:
    """By number of samples: the window sum above which the right tail is below the channel's share of alpha."""
    alpha = cfg.nis_alpha / max(1, channels)
    return [float("inf")] + [chi2_isf(alpha, n * dof) for n in range(1, cfg.window_len + 1)]


def order_checks(rows: DataFrame, cfg: DetectorConfig) -> DataFrame:
    """Add prev_seq, prev_timestamp_ms, ``reject`` (null if sound) and ``discontinuous`` (a gap that asks for a reset); no resets."""
    return ordering.checked(rows, cfg, resets=False).drop("generation", "is_reset", "cusum_hi", "cusum_lo")


def generations(rows: DataFrame, cfg: DetectorConfig, modalities: tuple[str, ...] | None = None) -> DataFrame:
    """The sound rows, with ``generation``, ``is_reset``, ``cusum_hi`` and ``cusum_lo``; a discontinuity begins a generation.

    Rejected rows are no evidence and aren't among them: ``rejected`` tells these.
    """
    return ordering.checked(rows, cfg, modalities).filter(F.col("reject").isNull())


def rejected(rows: DataFrame, cfg: DetectorConfig, modalities: tuple[str, ...] | None = None) -> DataFrame:
    """The rows that ``generations`` leaves out, with why."""
    return ordering.checked(rows, cfg, modalities).filter(F.col("reject").isNotNull()).drop("cusum_hi", "cusum_lo")


def channel_windows(rows: DataFrame, cfg: DetectorConfig) -> DataFrame:
    """Rows with track_id, generation, modality, seq and nis: add n, sum_nis and mean_nis of the channel's newest ``window_len`` rows.

    Sums are those of the window's own rows, exact and rounded once, so neither
    the order of rows nor what has left a window leaves a trace; a sum that no
    double holds is the largest double.
    """
    own = Window.partitionBy(*KEY).orderBy("seq").rowsBetween(-(cfg.window_len - 1), 0)
    sums = exact.window_sums(rows.withColumn("n", F.count(F.lit(1)).over(own)), "nis", KEY, "seq", cfg.window_len, "sum_nis", "mean_nis")
    return sums.drop("limbs")


def channel_reports(rows: DataFrame, cfg: DetectorConfig, channels: int, dofs: tuple[int, ...] = (3,)) -> DataFrame:
    """Add ``elevated``, ``high`` and ``low`` alarms, ``anomalous`` and ``sampled`` to channel_windows."""
    def critical() -> Column:
        out = None
        for d in dofs:
            listed = ", ".join("double('infinity')" if math.isinf(x) else f"{x!r}D" for x in critical_values(cfg, channels, d))
            values = F.expr(f"array({listed})[CAST(n AS INT)]")
            out = F.when(F.col("dof") == d, values) if out is None else out.when(F.col("dof") == d, values)
        return out

    return rows.withColumns(
        {"elevated": F.coalesce(F.col("sum_nis") > critical(), F.lit(False)), "high": F.col("cusum_hi") >= cfg.cusum_threshold, "low": F.col("cusum_lo") >= cfg.cusum_threshold, "sampled": F.col("n") >= cfg.min_samples}
    ).withColumn("high_anomalous", F.col("elevated") | F.col("high")).withColumn("anomalous", F.col("elevated") | F.col("high") | F.col("low"))


def frames(
    reports: DataFrame, modalities: tuple[str, ...], extra: tuple[str, ...] = (), flags: tuple[str, ...] = ("is_reset",)
) -> DataFrame:
    """One row a (track_id, generation, seq): columns of each channel as ``<modality>_<column>``, null where it is absent, and flags."""
    mods = canonical(modalities)
    columns = ("timestamp_ms", "sampled", "high_anomalous", "anomalous", "low", *extra)
    picked = [F.max(F.when(F.col("modality") == m, F.col(c))).alias(f"{m}_{c}") for m in mods for c in columns]
    return reports.groupBy("track_id", "generation", "seq").agg(*picked, *(F.max(c).alias(c) for c in flags))


def labels(conditions: dict[str, Column]) -> Column:
    """The names whose condition holds, in their order, joined by commas."""
    return F.concat_ws(",", *(F.when(c, F.lit(m)) for m, c in conditions.items()))


def magnitude_verdict(wide: DataFrame, cfg: DetectorConfig, modalities: tuple[str, ...]) -> DataFrame:
    """Add ready, magnitude_verdict and magnitude_channels.

    A channel is ready if it has enough samples and a row in just this frame.
    Missing or incoherent evidence is ``insufficient``, never ``nominal``; an
    anomaly beside it, or one below the target, is ``unclassified``.
    """
    mods = canonical(modalities)
    is_ready = {m: F.coalesce(F.col(f"{m}_sampled"), F.lit(False)) for m in mods}
    flag = lambda m, c: is_ready[m] & F.coalesce(F.col(f"{m}_{c}"), F.lit(False))
    count = lambda conditions: sum((c.cast("int") for c in conditions), F.lit(0))
    stamps = [F.when(is_ready[m], F.col(f"{m}_timestamp_ms")) for m in mods]
    span = F.coalesce(F.greatest(*stamps) - F.least(*stamps), F.lit(0)) if len(mods) > 1 else F.lit(0)
    ready, high = count(is_ready.values()), count(flag(m, "high_anomalous") for m in mods)
    anomalous = {m: flag(m, "anomalous") for m in mods}
    complete = (ready >= cfg.min_channels) & (ready == len(mods)) & (span <= cfg.max_timestamp_skew_ms)
    some, low = count(anomalous.values()) > 0, count(flag(m, "low") for m in mods) > 0
    verdict = (
        F.when(some & (~complete | low), "unclassified")
        .when(~complete, "insufficient")
        .when(high == 0, "nominal")
        .when((high >= 2) & (high >= cfg.jam_fraction * ready), "broad")
        .otherwise("attributed")
    )
    return wide.withColumns({"ready": ready, "magnitude_verdict": verdict, "magnitude_channels": labels(anomalous)})
