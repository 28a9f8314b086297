"""Batch reconciliation of frame ledgers: counts against summaries, completeness, and the join of observations with what was expected."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from accordant.operators.admission import first_broken

PAIR = ("fusion_seq", "track_id", "modality")
#: Outcomes after which no more may follow for the same pair.
TERMINAL = ("updated", "update_rejected", "unsupported_filter", "incomparable_projection")


def pair_ledger(outcomes: DataFrame) -> DataFrame:
    """One row a (frame, track, modality): its outcomes, and what about them is incoherent."""
    own = Window.partitionBy(*PAIR).orderBy("attempt_index")
    rows = outcomes.withColumns({"_gap": F.col("attempt_index") != F.row_number().over(own) - 1, "_back": F.coalesce(F.col("measurement_index") <= F.lag("measurement_index").over(own), F.lit(False))})
    return rows.groupBy(*PAIR).agg(
        F.count("*").alias("n_outcomes"), F.count_if("v1_expected").alias("n_v1"), F.count_if(F.col("outcome").isin(*TERMINAL)).alias("n_terminal"), F.bool_or("_gap").alias("attempt_gap"), F.bool_or("_back").alias("measurement_regressed"),
        ((F.min("candidate_count") != F.max("candidate_count")) | (F.min("in_gate_count") != F.max("in_gate_count"))).alias("counts_differ"),
    )


def reconcile(outcomes: DataFrame, summaries: DataFrame, max_attempts: int = 64) -> DataFrame:
    """One row a summary: received counts and the first ``fault``, null if the frame is sound.

    Every track of the frame must have an entry for every expected modality.
    """
    pairs = pair_ledger(outcomes)
    frames = pairs.groupBy("fusion_seq").agg(
        F.sum("n_outcomes").alias("received"), F.sum("n_v1").alias("v1_received"), F.count("*").alias("n_pairs"), F.countDistinct("track_id").alias("n_tracks"), F.collect_set("modality").alias("_modalities"),
        F.bool_or("attempt_gap").alias("_gap"), F.bool_or("measurement_regressed").alias("_back"), F.bool_or("counts_differ").alias("_differ"), F.max("n_v1").alias("_v1_most"), F.max("n_terminal").alias("_terminal_most"), F.max("n_outcomes").alias("_attempts"),
    )
    both = summaries.join(frames, "fusion_seq", "left")
    count = lambda c: F.coalesce(F.col(c), F.lit(0))
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    fault = first_broken(
        [
            ("outcome_count_mismatch", count("received") != F.col("outcome_count")),
            ("unexpected_modality", F.size(F.array_except(F.coalesce("_modalities", F.array().cast("array<string>")), "expected_modalities")) > 0),
            ("attempt_gap", flag("_gap")),
            ("measurement_regressed", flag("_back")),
            ("attempts_over_limit", count("_attempts") > max_attempts),
            ("gate_counts_differ", flag("_differ")),
            ("repeated_expectation", count("_v1_most") > 1),
            ("repeated_terminal", count("_terminal_most") > 1),
            ("too_few_tracks", F.col("active_track_count") > count("n_tracks")),
            ("missing_pair", count("n_pairs") < count("n_tracks") * F.size("expected_modalities")),
            ("v1_count_mismatch", count("v1_received") != F.col("v1_expected_count")),
        ]
    )
    return both.withColumn("fault", fault).select("fusion_seq", count("received").alias("received"), count("v1_received").alias("v1_received"), count("n_tracks").alias("n_tracks"), "fault")


def join_observations(outcomes: DataFrame, observations: DataFrame, key: tuple[str, ...] = PAIR) -> DataFrame:
    """Observations against expectations, both ways: matched, unexpected, missing, or which field differs.

    ``key`` tells expectations apart: a frame's channel has one, else its
    measurements do. Rows that repeat a key are each held against each.
    """
    expected = outcomes.filter("v1_expected").select(*key, F.col("fusion_timestamp_ms").alias("_ts"), F.col("projection").alias("_projection"), F.lit(True).alias("_expected"))
    given = observations.select(*key, "timestamp_ms", "projection", F.lit(True).alias("_given"))
    status = F.when(F.col("_expected").isNull(), "unexpected").when(F.col("_given").isNull(), "missing").when(F.col("timestamp_ms") != F.col("_ts"), "timestamp_mismatch").when(~F.col("projection").eqNullSafe(F.col("_projection")), "projection_mismatch").otherwise("matched")
    return expected.join(given, list(key), "full_outer").select(*key, status.alias("status"))


def unprojected(expected: DataFrame, observations: DataFrame) -> DataFrame:
    """Expected (track, modality) without a projected observation: these abstain."""
    return expected.join(observations.filter(F.col("projection").isNotNull()).select("track_id", "modality"), ["track_id", "modality"], "left_anti")


def only_frozen(rows: DataFrame, frozen: DataFrame) -> DataFrame:
    """Rows of tracks that the frame froze."""
    return rows.join(frozen.select("track_id"), "track_id", "left_semi")


def frozen_faults(observations: DataFrame, frames: DataFrame, frozen: DataFrame, order: str) -> DataFrame:
    """Each observation with the first ``fault`` that it has against its frame's frozen ledger, null if it has none.

    ``frames`` has one row a fusion_seq with its time, modalities and identity,
    ``frozen`` the tracks of each; of repeated channels all but the first by
    ``order``, then by all other columns, are told. Projections are held to the frame's identity. All
    keys begin with the frame, which a frame's ceiling bounds.
    """
    ids = ("frame_id", "context_id", "prior_id")
    of = frames.select("fusion_seq", F.col("fusion_timestamp_ms").alias("_ts"), F.col("expected_modalities").alias("_mods"), *(F.col(c).alias(f"_{c}") for c in ids))
    known = frozen.select("fusion_seq", "track_id", F.lit(True).alias("_frozen")).distinct()
    nth = F.row_number().over(Window.partitionBy("fusion_seq", "track_id", "modality").orderBy(order, *(c for c in observations.columns if c != order)))
    rows = observations.withColumn("_nth", nth).join(of, "fusion_seq", "left").join(known, ["fusion_seq", "track_id"], "left")
    differs = [~F.col(c).eqNullSafe(F.col(f"_{c}")) for c in ids]
    fault = first_broken(
        [
            ("unknown_frame", F.col("_mods").isNull()),
            ("track_not_frozen", F.col("_frozen").isNull()),
            ("unexpected_modality", ~F.array_contains("_mods", F.col("modality"))),
            ("repeated_observation", F.col("_nth") > 1),
            ("observation_position", (F.col("seq") != F.col("fusion_seq")) | (F.col("timestamp_ms") != F.col("_ts"))),
            ("projection_provenance", F.col("projection").isNotNull() & (differs[0] | differs[1] | differs[2])),
        ]
    )
    return rows.withColumn("fault", fault).select(*observations.columns, "fault")
