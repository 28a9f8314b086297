import pytest
from pyspark.sql import functions as F

from accordant.operators import ledger, metrics, preflight

TRIAL = "role string, assessments bigint, abstentions bigint, episodes bigint, first_alert bigint, pre_onset_alerts bigint, delay_frames bigint, first_attribution_correct boolean, duration_ms bigint"


def test_metrics_by_hand(spark):
    rows = [
        ("a", 100, 10, 2, 30, 0, 5, True, 10_000), ("a", 100, 0, 1, 45, 0, 25, False, 10_000), ("a", 200, 50, 0, None, 0, None, None, 20_000),
        ("a", 100, 0, 3, 3, 2, 1, True, 10_000), (None, 50, 50, 0, None, 0, None, None, 0),
    ]
    told = metrics.condition_metrics(spark.createDataFrame(rows, TRIAL), ["role"], 100, 40, 2).collect()
    got = {(r.role, r.metric): (round(r.value, 6), r.eligible) for r in told}
    assert {k[1]: v for k, v in got.items() if k[0] == "a"} == {
        "episodes_per_hour": (432.0, 4), "mission_alert": (0.5, 4), "any_alert": (0.75, 4), "arl0": (69.5, 4), "arl0_censored": (0.25, 4), "abstention": (0.12, 4), "pre_onset": (0.25, 4),
        "detected": (round(2 / 3, 6), 3), "delay_median_frames": (15.0, 2), "delay_p95_ms": (2_500.0, 2), "attribution_emitted": (round(2 / 3, 6), 3), "attribution_correct": (0.5, 2), "attribution_wrong": (0.5, 2),
    }
    # No duration, no rate; no detection, no delay; one trial has no interval.
    alone = {r.metric: r for r in told if r.role is None}
    assert set(alone) == {"mission_alert", "any_alert", "arl0", "arl0_censored", "abstention", "pre_onset", "detected", "attribution_emitted"}
    assert all(r.low is None and r.high is None for r in alone.values())
    assert metrics.condition_metrics(spark.createDataFrame([], TRIAL), ["role"], 100, 40).count() == 0


def test_acceptance(spark):
    found = spark.createDataFrame([("a", "x", 0.1, 0.0, 0.2), ("a", "y", 0.1, None, None), ("b", "x", 0.5, 0.2, 0.9)], "role string, metric string, value double, low double, high double")
    rules = spark.createDataFrame([("a", "x", 0.2), ("a", "x", 0.1), ("a", "y", 9.0), ("b", "x", 0.9), ("c", "x", 1.0)], "role string, metric string, most double")
    told = {(r.role, r.metric, r.most): r.accepted for r in metrics.accepted(found, rules).collect()}
    assert told == {("a", "x", 0.2): True, ("a", "x", 0.1): False, ("a", "y", 9.0): False, ("b", "x", 0.9): True, ("c", "x", 1.0): False}


def test_work(spark):
    rows = spark.createDataFrame([(t, s, m) for t, n in ((1, 25), (2, 3)) for s in range(n) for m in ("radar", "visual")] + [(1, None, "lidar"), (1, 3, "radar")], "track_id long, seq long, modality string")
    told = {r.track_id: tuple(r)[1:] for r in preflight.track_work(rows, 10, 20).collect()}
    assert told == {1: (25, 2, 6, 3 * 3 * 20, 24), 2: (3, 2, 2, 1 * 3 * 3, 2)}
    assert preflight.work(rows, 10, 20).first().fault is None
    assert preflight.work(rows.filter("seq < 0"), 10, 20).first().fault == "no_observations"
    many = spark.range(1_000_002).select(F.lit(1).alias("track_id"), F.col("id").alias("seq"), F.lit("radar").alias("modality"))
    assert preflight.work(many, 1, 20).first().fault == "too_many_assessments" and preflight.work(many, 10, 20).first().fault == "too_many_resets"
    with pytest.raises(ValueError):
        preflight.work(rows, 0, 1)


def test_frozen_ledger(spark):
    frames = spark.createDataFrame([(1, 100, ["radar", "visual"], 1, 1, 2)], "fusion_seq long, fusion_timestamp_ms long, expected_modalities array<string>, frame_id long, context_id long, prior_id long")
    frozen = spark.createDataFrame([(1, 7), (1, 7), (2, 7)], "fusion_seq long, track_id long")
    good = (1, 7, "radar", 0, 1, 100, 0.5, 1, 1, 2)
    change = lambda **k: tuple(k.get(c, v) for c, v in zip(("fusion_seq", "track_id", "modality", "ordinal", "seq", "timestamp_ms", "projection", "frame_id", "context_id", "prior_id"), good, strict=True))
    cases = [
        (good, None), (change(ordinal=1), "repeated_observation"), (change(modality="visual", projection=None, frame_id=None, context_id=9), None), (change(ordinal=2, fusion_seq=3), "unknown_frame"),
        (change(ordinal=3, fusion_seq=2), "unknown_frame"), (change(ordinal=4, track_id=8), "track_not_frozen"), (change(ordinal=5, modality="lidar"), "unexpected_modality"), (change(ordinal=6, modality=None), "unexpected_modality"), (change(ordinal=7, track_id=None), "track_not_frozen"),
    ]
    schema = "fusion_seq long, track_id long, modality string, ordinal long, seq long, timestamp_ms long, projection double, frame_id long, context_id long, prior_id long"
    told = ledger.frozen_faults(spark.createDataFrame([c for c, _ in cases], schema), frames, frozen, "ordinal").collect()
    assert sorted(((tuple(r)[:-1], r.fault) for r in told), key=str) == sorted(cases, key=str)
    for bad, fault in ((change(seq=2), "observation_position"), (change(timestamp_ms=None), "observation_position"), (change(prior_id=None), "projection_provenance"), (change(context_id=2), "projection_provenance")):
        assert ledger.frozen_faults(spark.createDataFrame([bad], schema), frames, frozen, "ordinal").first().fault == fault
