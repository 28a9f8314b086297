"""Sequence analytics over assessed frames: spans, alert episodes, histories, time to detect."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ALERTS = ("attributed", "broad", "unclassified")


def label_spans(rows: DataFrame, by: list[str], order: str, label: str) -> DataFrame:
    """Runs of one label: first, last and number of frames."""
    w = Window.partitionBy(*by).orderBy(order)
    starts = F.coalesce((F.col(label) != F.lag(label).over(w)), F.lit(True)).cast("int")
    return rows.withColumn("_start", starts).withColumn("span", F.sum("_start").over(w)).groupBy(*by, "span", label).agg(F.min(order).alias("first_seq"), F.max(order).alias("last_seq"), F.count("*").alias("n_frames"))


def alert_state(verdict: Column) -> Column:
    """alert, nominal or insufficient."""
    return F.when(verdict.isin(*ALERTS), "alert").otherwise(verdict)


def episode_starts(rows: DataFrame, by: list[str], order: str, state: str) -> DataFrame:
    """Add ``starts_episode``: an alert begins an episode unless one is open; only a nominal frame closes it, missing evidence doesn't."""
    before = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    known = F.last(F.when(F.col(state).isin("alert", "nominal"), F.col(state)), ignorenulls=True).over(before)
    return rows.withColumn("starts_episode", (F.col(state) == "alert") & ~F.coalesce(known == "alert", F.lit(False)))


def trial_records(rows: DataFrame, by: list[str], order: str, state: str, onset: Column, frame_ms: int, correct: Column) -> DataFrame:
    """One row a trial: assessments, abstentions, episodes, first alerts, delay and attribution.

    ``correct`` says whether a frame's attribution is right, null where it has none.
    """
    frames = episode_starts(rows, by, order, state).withColumn("_onset", onset).withColumn("_correct", correct)
    alert = F.col(state) == "alert"
    after = F.col(order) >= F.col("_onset")
    return frames.groupBy(*by).agg(
        F.count("*").alias("assessments"), F.count_if(F.col(state) == "insufficient").alias("abstentions"), F.count_if("starts_episode").alias("episodes"),
        F.min(F.when(alert, F.col(order))).alias("first_alert"), F.count_if(alert & ~after).alias("pre_onset_alerts"), F.min(F.when(alert & after, F.col(order) - F.col("_onset"))).alias("delay_frames"),
        F.min_by("_correct", F.when(F.col("_correct").isNotNull() & after, F.col(order))).alias("first_attribution_correct"), (F.count("*") * frame_ms).alias("duration_ms"),
    )


def span(name: str, condition: Column, order: str) -> list[Column]:
    """Frames, first and last sequence at which the condition holds."""
    at = F.when(condition, F.col(order))
    return [F.count(at).alias(f"{name}_frames"), F.min(at).alias(f"{name}_first"), F.max(at).alias(f"{name}_last")]


def replay_histories(assessed: DataFrame) -> DataFrame:
    """One row a track: spans of alarms, missing evidence, resets and consistency faults, and the last verdicts."""
    v, f, s = F.col("magnitude_verdict"), F.col("fused_verdict"), F.col("consistency_status")
    lacking = (f == "insufficient") | (s != "assessed")
    return assessed.groupBy("track_id").agg(
        F.count("*").alias("frames"), *span("baseline_alarm", v.isin(*ALERTS), "seq"), *span("baseline_insufficient", v == "insufficient", "seq"), *span("alarm", f.isin(*ALERTS), "seq"), *span("insufficient", lacking, "seq"), *span("reset", F.col("is_reset"), "seq"),
        *span("missing_projection", s == "missing_projection", "seq"), *span("extraction_error", s == "extraction_error", "seq"), *span("analysis_error", s == "analysis_error", "seq"),
        F.max_by("magnitude_verdict", "seq").alias("terminal_baseline"), F.max_by("fused_verdict", "seq").alias("terminal_verdict"),
    )


def with_suppressed_rest(histories: DataFrame, reported: int) -> DataFrame:
    """The first ``reported`` tracks one by one, all others as one row without an id: number of tracks and of those with alarms or missing evidence."""
    # Ids only; a top-k of bounded size decides which tracks are told.
    told = histories.select("track_id").orderBy("track_id").limit(reported).select("track_id", F.lit(True).alias("_told"))
    marked = histories.join(F.broadcast(told), "track_id", "left").withColumn("track_id", F.when(F.col("_told"), F.col("track_id")))
    return marked.groupBy("track_id").agg(F.count("*").alias("tracks"), F.sum("frames").alias("frames"), F.count_if(F.col("alarm_frames") > 0).alias("alarm_tracks"), F.count_if(F.col("insufficient_frames") > 0).alias("insufficient_tracks"), F.sum("alarm_frames").alias("alarm_frames"), F.min("alarm_first").alias("alarm_first"), F.max("alarm_last").alias("alarm_last"))


def realized_counts(rows: DataFrame) -> DataFrame:
    """One row a (track_id, modality): its observations, and of how many of the track's frames it is missing."""
    channels = rows.groupBy("track_id", "modality").agg(F.countDistinct("seq").alias("observations"))
    frames = rows.groupBy("track_id").agg(F.countDistinct("seq").alias("_frames"))
    missing = F.col("_frames") - F.col("observations")
    return channels.join(frames, "track_id").select("track_id", "modality", "observations", missing.alias("missing_frames"))


def labelled_union(parts: dict[str, DataFrame]) -> DataFrame:
    """Rows of several origins with ``origin``; a track is that of its origin, as numbers may repeat."""
    out = None
    for name, rows in parts.items():
        part = rows.withColumn("origin", F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def ordered(rows: DataFrame) -> DataFrame:
    """All rows in order of track, sequence and channel code."""
    return rows.orderBy("track_id", "seq", "code")


def first_tracks(rows: DataFrame, limit: int = 8) -> DataFrame:
    """The first tracks by number: as many as an expensive analysis is run for."""
    return rows.select("track_id").distinct().orderBy("track_id").limit(limit)
