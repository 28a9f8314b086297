"""Rules of monitor events (heartbeats, outcomes, misses, summaries) as the first broken rule of a row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from accordant.operators.admission import finite, first_broken, safe_integer

MAX_QUEUE_EVENTS, MAX_FRAME_ITEMS, MAX_ACTIVE_TRACKS = 65_536, 65_536, 65_536
_MEASURED = ("updated", "update_rejected", "track_birth", "unsupported_filter", "incomparable_projection")
_GATED = ("updated", "update_rejected", "incomparable_projection")


def heartbeat_fault() -> Column:
    """Columns producer_timestamp_ms, uptime_ms, declared_interval_ms, declared_deadline_ms, active_track_count, degraded, capacity, depth, dropped, published."""
    c = F.col
    return first_broken(
        [
            ("timestamp_out_of_range", ~safe_integer(c("producer_timestamp_ms"))),
            ("uptime_out_of_range", ~safe_integer(c("uptime_ms"))),
            ("interval_out_of_range", c("declared_interval_ms") < 1),
            ("deadline_before_interval", c("declared_deadline_ms") < c("declared_interval_ms")),
            ("track_count_out_of_range", ~c("active_track_count").between(0, MAX_ACTIVE_TRACKS)),
            ("queue_capacity_out_of_range", ~c("capacity").between(1, MAX_QUEUE_EVENTS)),
            ("queue_depth_over_capacity", c("depth") > c("capacity")),
            ("queue_counter_out_of_range", ~(safe_integer(c("dropped")) & safe_integer(c("published")))),
            ("dropped_but_not_degraded", (c("dropped") > 0) & ~c("degraded")),
        ]
    )


def frame_rules(track: bool = True) -> list[tuple[str, Column]]:
    c = F.col
    rules = [("fusion_seq_out_of_range", ~safe_integer(c("fusion_seq"))), ("fusion_timestamp_out_of_range", ~safe_integer(c("fusion_timestamp_ms")))]
    rules += [(f"{x}_out_of_range", ~safe_integer(c(x), 1)) for x in ("frame_id", "context_id", "prior_id")]
    return [*rules, ("track_id_out_of_range", ~safe_integer(c("track_id")))] if track else rules


MISS_REASONS = ("no_measurement", "no_candidate", "no_in_gate_candidate", "not_assigned", "track_not_eligible")


def miss_fault() -> Column:
    """Columns of the frame's identity with its track, and reason."""
    return first_broken([*frame_rules(), ("reason_unknown", ~F.coalesce(F.col("reason").isin(*MISS_REASONS), F.lit(False)))])


def summary_fault() -> Column:
    """Columns of the frame's identity, registry_digest, expected_modalities, active_track_count, input_count, outcome_count, v1_expected_count, degraded and truncated."""
    c = F.col
    most = {"active_track_count": MAX_ACTIVE_TRACKS} | dict.fromkeys(("input_count", "outcome_count", "v1_expected_count"), MAX_FRAME_ITEMS)
    expected = F.coalesce(c("expected_modalities"), F.array().cast("array<string>"))
    return first_broken(
        [
            *frame_rules(track=False),
            ("registry_digest_invalid", ~F.coalesce(c("registry_digest").rlike("^[0-9a-f]{64}$"), F.lit(False))),
            *((f"{name}_out_of_range", ~c(name).between(0, limit)) for name, limit in most.items()),
            ("v1_over_outcomes", c("v1_expected_count") > c("outcome_count")),
            ("truncated_but_not_degraded", c("truncated") & ~c("degraded")),
            ("expected_modalities_empty", F.size(expected) == 0),
            ("expected_modality_repeated", F.size(F.array_distinct(expected)) < F.size(expected)),
        ]
    )


def outcome_fault() -> Column:
    """Columns of the frame's identity, attempt_index, measurement_index, outcome, v1_expected, candidate_count, in_gate_count, d2, threshold (null without evidence) and has_projection."""
    c = F.col
    kind, evidence = c("outcome"), c("d2").isNotNull() & c("threshold").isNotNull()
    no = F.lit(False)
    accepted = evidence & (c("d2") < c("threshold"))
    only = lambda kinds, broken: F.when(kind.isin(*kinds), broken).otherwise(no)
    return first_broken(
        [
            *frame_rules(),
            ("attempt_index_out_of_range", ~c("attempt_index").between(0, MAX_FRAME_ITEMS - 1)),
            ("measurement_index_out_of_range", F.coalesce(~c("measurement_index").between(0, MAX_FRAME_ITEMS - 1), no)),
            ("in_gate_over_candidates", c("in_gate_count") > c("candidate_count")),
            ("gate_value_invalid", F.when(evidence, ~(finite(c("d2")) & finite(c("threshold")) & (c("d2") >= 0) & (c("threshold") >= 0))).otherwise(no)),
            ("v1_not_allowed", c("v1_expected") & ~kind.isin("updated", "incomparable_projection")),
            ("updated_without_v1", only(("updated",), ~c("v1_expected"))),
            ("measurement_index_missing", only(_MEASURED, c("measurement_index").isNull())),
            ("candidates_missing", only(_GATED, (c("candidate_count") == 0) | (c("in_gate_count") == 0))),
            ("gate_not_accepted", only((*_GATED, "assignment_rejected"), F.when(evidence, ~accepted).otherwise(F.lit(True)))),
            ("updated_without_projection", only(("updated",), ~c("has_projection"))),
            ("gate_rejected_without_candidate", only(("gate_rejected",), c("candidate_count") == 0)),
            ("gate_rejected_without_evidence", only(("gate_rejected",), ~evidence)),
            ("gate_rejected_inside_gate", only(("gate_rejected",), c("d2") < c("threshold"))),
            ("assignment_without_in_gate", only(("assignment_rejected",), c("in_gate_count") == 0)),
            ("birth_with_evidence", only(("track_birth",), (c("candidate_count") != 0) | (c("in_gate_count") != 0) | evidence | c("has_projection"))),
            ("unsupported_with_gate", only(("unsupported_filter",), evidence)),
            ("incomparable_with_projection", only(("incomparable_projection",), c("has_projection"))),
        ]
    )
