import json
import time

import pytest

from accordant.streaming.assembler import Assembler, AssemblerLimits, assembled
from accordant.streaming.registries import Registries, publish

SLOW = AssemblerLimits(frame_deadline_ms=10**7, reorder_deadline_ms=10**7, heartbeat_deadline_ms=10**7, initial_deadline_ms=10**7)
SCHEMA = "session_id string, producer_id string, ordinal int, received_ms long, route string, payload string"


def document(version=1, until=None, modalities=("radar", "visual"), **opportunity):
    when = {"valid_from_timestamp_ms": 0, "valid_until_timestamp_ms": until}
    context = {"context_id": 1, "frame_id": 1, "applicability": when, "expected_modalities": [{"modality": m} for m in modalities]}
    frames = [{"frame_id": i, "applicability": when} for i in (1, 2)]
    return json.dumps({"version": version, "frames": frames, "contexts": [context], "opportunity": opportunity})


def events(digest, seq=0, first=0, projection=None, more=(), **summary):
    """The monitor's rows of a frame, the first with a heartbeat before it."""
    ids = {"fusion_seq": seq, "fusion_timestamp_ms": 100 + seq, "frame_id": 1, "context_id": 1, "prior_id": seq + 1} | {k: summary[k] for k in ("frame_id", "context_id") if k in summary}
    out = [{"event_seq": 0, "type": "heartbeat", "data": {"last_fusion_seq": None}}] if first == 0 else []
    for m in ("visual", "radar"):
        told = {"track_id": 1, "modality": m, "v1_expected": False, "projection": projection} | dict(more)
        out.append({"event_seq": first + len(out), "type": "modality_outcome", "data": ids | told})
    whole = {"expected_modalities": ["visual", "radar"], "outcome_count": 2, "v1_expected_count": 0, "registry_digest": digest}
    out.append({"event_seq": first + len(out), "type": "frame_summary", "data": ids | whole | summary})
    return out


def run(folder, rows):
    """The fault of a key's rows, or the number of its frames."""
    known, saved, n = Registries(folder), None, 0
    for e in rows:
        machine = Assembler(SLOW, saved, known)
        n += sum(o["kind"] == "frame" for o in machine.offer("monitor", e, 10))
        saved = machine.save()
    return machine.fault or n


@pytest.fixture
def folder(tmp_path):
    return f"file://{tmp_path}/registries"


def test_a_registry_is_found_by_its_digest(folder):
    one = publish(document(), folder)
    assert publish(document(), folder) == one and run(folder, events(one)) == 1
    assert run(folder, events("0" * 64)) == "registry_unknown"
    for bad in (None, "../x", 5, one.upper()):
        assert run(folder, events(bad)) == "registry_digest"


def test_documents_are_checked(folder, tmp_path):
    for text in (document(version="1"), document(max_tracks=1), document(max_active_tracks=0), document(max_active_tracks=True), document(modalities=("radar", "radar"))):
        with pytest.raises(ValueError):
            publish(text, folder)
    one = publish(document(), folder)
    path = tmp_path / "registries" / f"{one}.json"
    path.write_text(path.read_text().replace("visual", "lidar"))
    assert run(folder, events(one)) == "registry_document"


@pytest.mark.parametrize(
    "summary, why",
    [
        ({"frame_id": 3}, "registry_unknown_frame"),
        ({"context_id": 2}, "registry_unknown_context"),
        ({"frame_id": 2}, "registry_frame_context"),
        ({"seq": 60}, "registry_not_applicable"),
        ({"expected_modalities": ["radar", "visual"]}, "registry_modalities"),
        ({"projection": {"frame_id": 1, "context_id": 1, "prior_id": 9}}, "registry_projection_identity"),
        ({"projection": {"frame_id": 1, "context_id": 1, "prior_id": 1}}, 1),
    ],
)
def test_frames_against_their_registry(folder, summary, why):
    assert run(folder, events(publish(document(until=150), folder), **summary)) == why


@pytest.mark.parametrize(
    "ceiling, given",
    [
        ({"max_active_tracks": 2}, {"active_track_count": 3}),
        ({"max_frame_inputs": 4}, {"input_count": 5}),
        ({"max_frame_inputs": 4}, {"more": {"measurement_index": 4}}),
        ({"max_attempts_per_track_modality": 1}, {"more": {"attempt_index": 1}}),
        ({"max_attempts_per_track_modality": 3}, {"more": {"candidate_count": 4}}),
        ({"max_outcomes_per_frame": 1}, {}),
    ],
)
def test_ceilings(folder, ceiling, given):
    (name,) = ceiling
    assert run(folder, events(publish(document(**ceiling), folder), **given)) == f"registry_limit:{name}"
    assert run(folder, events(publish(document(**{name: ceiling[name] + 1}), folder), **given)) == 1


def test_heartbeats_are_held_to_the_last_registry(folder):
    one = publish(document(max_monitor_queue_events=8), folder)
    beat = lambda n: {"event_seq": 4, "type": "heartbeat", "data": {"last_fusion_seq": 0, "queue_capacity": n}}
    assert run(folder, [*events(one), beat(8)]) == 1
    assert run(folder, [*events(one), beat(9)]) == "registry_limit:max_monitor_queue_events"


def test_versions_never_go_back(folder):
    one, two, same = publish(document(1), folder), publish(document(2), folder), publish(document(2, until=900), folder)
    assert run(folder, [*events(one), *events(two, 1, 4), *events(two, 2, 7)]) == 3
    for other in (one, same):
        assert run(folder, [*events(two), *events(other, 1, 4)]) == "registry_regressed"


def test_without_registries_none_is_asked_for():
    machine = Assembler(SLOW)
    out = [o for e in events(None) for o in machine.offer("monitor", e, 10)]
    assert machine.fault is None and [o["kind"] for o in out] == ["heartbeat", "frame"]


def test_a_running_stream_takes_a_new_registry(spark, tmp_path, folder):
    """The second document is published while the query runs; one key names it, another one that nobody published."""
    one = publish(document(1), folder)
    given = tmp_path / "in"

    def put(rows):
        told = [("s", p, i, 10 + i, "monitor", json.dumps(e)) for p, es in rows for i, e in enumerate(es)]
        spark.createDataFrame(told, SCHEMA).coalesce(1).write.mode("append").parquet(str(given))

    put([("a", events(one)), ("b", events(one))])
    stream = spark.readStream.schema(SCHEMA).parquet(str(given))
    q = assembled(stream, SLOW, Registries(folder)).writeStream.format("memory").queryName("registered").outputMode("append").start()

    def until(n):
        end = time.time() + 60
        while time.time() < end and spark.table("registered").count() < n:
            time.sleep(0.3)

    try:
        until(4)
        two = publish(document(2), folder)
        put([("a", events(two, 1, 4)), ("b", events("f" * 64, 1, 4))])
        until(6)
    finally:
        q.stop()
    told = sorted((r.producer_id, r.kind, r.fusion_seq) for r in spark.table("registered").collect())
    assert told == [("a", "frame", 0), ("a", "frame", 1), ("a", "heartbeat", -1), ("b", "fault", 1), ("b", "frame", 0), ("b", "heartbeat", -1)]
