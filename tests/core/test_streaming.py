import json
import time

import pytest
from pyspark.sql import functions as F

from accordant import views
from accordant.operators import fusion, magnitude
from accordant.plans.detectors import MODS, SHORT_CORR, SHORT_DETECTOR
from accordant.streaming.assembler import Assembler, AssemblerLimits, assembled
from accordant.streaming.detector import VERDICT, Track, verdicts

SF = "/root/testdata/sf0.001"


def run(spark, stream, name, timers=False):
    q = stream.writeStream.format("memory").queryName(name).outputMode("append").start()
    if timers:
        # A stream with timers never runs out of batches: the first one without input comes after all that is there.
        until = time.time() + 90
        while time.time() < until and not (len(p := q.recentProgress) > 1 and p[-1]["numInputRows"] == 0 and any(x["numInputRows"] for x in p)):
            time.sleep(0.2)
    else:
        q.processAllAvailable()
    q.stop()
    return spark.table(name).collect()


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@pytest.fixture
def typed_state(spark):
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    yield
    spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)


def hard_rows(rows):
    """The capture and what else must not end a query: rows without a value, huge, infinite and negative ones, and other channels."""
    one = rows.filter("modality = 'radar' AND seq IN (12, 33, 90)")
    null = [one.withColumn(c, F.lit(None).cast(t)) for c, t in (("nis", "double"), ("dof", "int"), ("timestamp_ms", "long"), ("modality", "string"))]
    bad = [one.withColumn("nis", F.lit(x)) for x in (float("inf"), -3.0, float("nan"))]
    huge = rows.withColumn("nis", F.when((F.col("seq") % 90).between(47, 48), F.lit(1.7e308)).otherwise(F.col("nis")))
    other = one.withColumns({"modality": F.lit("lidar"), "timestamp_ms": F.col("timestamp_ms") + 1})
    for extra in (*null, *bad, other):
        huge = huge.unionByName(extra)
    return huge


def test_stream_equals_batch(spark, tmp_path, typed_state):
    rows = hard_rows(views.captured(spark, SF)).cache()
    half = rows.agg(F.max("seq")).first()[0] // 2
    rows.filter(F.coalesce(F.col("seq") <= half, F.lit(True))).coalesce(1).write.parquet(f"{tmp_path}/in")
    rows.filter(F.col("seq") > half).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    told = run(spark, verdicts(stream, MODS, SHORT_DETECTOR, SHORT_CORR), "v")
    got = {(r.track_id, r.seq): (r.generation, *(r[c] for c in VERDICT)) for r in told if r.reason is None}
    refused = sorted(str((r.track_id, r.seq, r.modality, r.reason)) for r in told if r.reason is not None)
    assert refused == sorted(str((r.track_id, r.seq, r.modality, r.reject)) for r in magnitude.rejected(rows, SHORT_DETECTOR, MODS).collect())
    assert {r.reason for r in told} >= {None, "incomplete", "invalid_value", "unexpected_modality", "sequence_not_increasing", "dof_changed"}
    assessed = fusion.assessed_frames(rows, MODS, SHORT_DETECTOR, SHORT_CORR).collect()
    batch = {(r.track_id, r.seq): (r.generation, *(r[c] for c in VERDICT)) for r in assessed}
    last = {t: max(s for u, s in batch if u == t) for t, _ in batch}
    want = {k: v for k, v in batch.items() if k[1] != last[k[0]]}
    assert got == want
    assert {v[4] for v in want.values()} >= {"assessed", "extraction_error", "missing_projection"} and len({v[5] for v in want.values()}) > 2


def test_a_quiet_track_is_told_by_its_timer(spark, tmp_path, typed_state):
    rows = views.scenario(spark, SF).filter("track_id = 0 AND seq < 3")
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    q = verdicts(stream, MODS, SHORT_DETECTOR, SHORT_CORR, quiet_ms=300).writeStream.format("memory").queryName("quiet").outputMode("append").start()
    try:
        until = time.time() + 60
        while time.time() < until and spark.table("quiet").count() < 3:
            time.sleep(0.3)
        assert sorted(r.seq for r in spark.table("quiet").collect()) == [0, 1, 2]
    finally:
        q.stop()


def test_refusals():
    t = Track(SHORT_DETECTOR, MODS)
    nothing = dict.fromkeys(("p0", "p1", "p2", "frame_id", "context_id", "prior_id"))
    row = lambda seq, m="radar", dof=3, nis=3.0: {"seq": seq, "timestamp_ms": None if seq is None else seq * 100 + 1, "modality": m, "nis": nis, "dof": dof} | nothing
    assert t.offer(row(1)) == [] and t.offer(row(2))[0]["fused_verdict"] == "insufficient"
    hard = (row(2), row(1), row(3, "lidar"), row(None), row(3, nis=float("nan")), row(3, nis=-1.0), row(3, nis=None), row(3, dof=2))
    assert [t.offer(x)[-1]["reason"] for x in hard] == [
        "sequence_not_increasing", "late_frame", "unexpected_modality", "incomplete", "invalid_value", "invalid_value", "incomplete", "dof_changed"
    ]


def test_typed_state_is_asked_for(spark):
    with pytest.raises(ValueError, match="providerClass"):
        verdicts(views.scenario(spark, SF), MODS)


IDS = {"fusion_timestamp_ms": 500, "frame_id": 1, "context_id": 1, "prior_id": 6}


def frame_events(seq=5, first=0, projection=1.0, **summary):
    ids = {**IDS, "fusion_seq": seq, "prior_id": seq + 1, "fusion_timestamp_ms": seq * 100}
    out = [{"event_seq": first, "type": "heartbeat", "data": {"last_fusion_seq": None}}]
    out += [{"event_seq": first + 1 + i, "type": "modality_outcome", "data": {**ids, "track_id": 1, "modality": m, "v1_expected": m == "radar", "projection": projection if m == "radar" else None}} for i, m in enumerate(("visual", "radar"))]
    return [*out, {"event_seq": first + 3, "type": "frame_summary", "data": {**ids, "expected_modalities": ["visual", "radar"], "outcome_count": 2, "v1_expected_count": 1, "degraded": False} | summary}]


OBS = {"seq": 5, "track_id": 1, "modality": "radar", "timestamp_ms": 500, "projection": 1.0}


@pytest.mark.parametrize("order", [(0, 1, 2, 3, 4), (4, 0, 1, 2, 3), (3, 2, 4, 1, 0), (0, 2, 1, 4, 3)])
def test_any_arrival_order_gives_the_frame(order):
    machine, items, out = Assembler(), [*[("monitor", e) for e in frame_events()], ("observation", OBS)], []
    for i in order:
        out += machine.offer(*items[i], now=10)
        machine = Assembler(saved=machine.save())
    assert sorted(o["kind"] for o in out) == ["frame", "heartbeat"] and json.loads(next(o for o in out if o["kind"] == "frame")["detail"])["observations"] == [OBS]


def faults(items, limits=None):
    machine, out = Assembler(limits), []
    for route, payload, now in items:
        out += machine.offer(route, payload, now)
    assert sum(o["kind"] == "fault" for o in out) <= 1
    return machine.fault, out


def test_faults_are_latched():
    m = lambda es, now=10: [("monitor", e, now) for e in es]
    assert faults([*m(frame_events()), *m(frame_events()[:1])])[0] == "event_duplicate_or_regressed"
    assert faults(m([{**frame_events()[0], "event_seq": 99}]))[0] == "event_distance"
    assert faults(m(frame_events(outcome_count=3)))[0] == "outcome_count_mismatch"
    assert faults(m(frame_events(degraded=True)))[0] == "degraded_frame"
    assert faults(m(frame_events(expected_modalities=["visual", "radar", "lidar"])))[0] == "invalid_ledger"
    assert faults([*m(frame_events()), ("observation", {**OBS, "timestamp_ms": 501}, 10)])[0] == "observation_timestamp_mismatch"
    assert faults([("observation", {**OBS, "modality": "visual"}, 9), *m(frame_events())])[0] == "unexpected_observation"
    assert faults([*m(frame_events(projection=2.0)), ("observation", OBS, 10)])[0] == "observation_projection_mismatch"
    late, out = faults([*m(frame_events()), ("observation", OBS, 10), ("observation", {**OBS, "track_id": 2}, 11), ("observation", {**OBS, "seq": 9}, 12)])
    assert late == "late_for_finalised_frame" and out[-1]["kind"] == "fault"


def test_deadlines():
    assert faults([("monitor", frame_events()[1], 0), ("observation", OBS, 1_000)])[0] == "reorder_deadline"
    assert faults([("monitor", frame_events()[0], 0), ("observation", OBS, 3_000)])[0] == "heartbeat_deadline"
    assert faults([("observation", OBS, 0), ("observation", {**OBS, "seq": 6}, 5_000)])[0] == "frame_deadline"
    assert Assembler(AssemblerLimits(initial_deadline_ms=5)).advance(100) == []


def test_next_deadline_is_when_advance_faults():
    machine = Assembler(AssemblerLimits(initial_deadline_ms=50))
    assert machine.next_deadline() is None
    machine.offer("observation", OBS, 100)
    assert machine.next_deadline() == 150 and machine.advance(149) == [] and machine.advance(150)[0]["detail"] == "initial_heartbeat_deadline"
    assert machine.next_deadline() is None
    machine = Assembler(AssemblerLimits(frame_deadline_ms=700))
    for e in frame_events()[:2]:
        machine.offer("monitor", e, 10)
    assert machine.next_deadline() == 710 and machine.advance(710)[0]["detail"] == "frame_deadline"


def test_priors_are_bounded():
    machine = Assembler(AssemblerLimits(max_priors=3))
    for i in range(10):
        for e in frame_events(seq=i + 1, first=4 * i)[1 if i else 0 :]:
            machine.offer("monitor", {**e, "event_seq": e["event_seq"]} if i == 0 else e, 10)
            if machine.fault:
                break
        machine.offer("observation", {**OBS, "seq": i + 1, "timestamp_ms": (i + 1) * 100}, 10)
    assert len(machine.priors) <= 4


def test_silence_expires_without_a_row(spark, tmp_path):
    """A producer that opens a frame and goes quiet faults by its timer; no further row comes."""
    rows = [("s", "quiet", 0, 1_000, "monitor", json.dumps(frame_events()[0])), ("s", "quiet", 1, 1_001, "observation", json.dumps(OBS))]
    spark.createDataFrame(rows, "session_id string, producer_id string, ordinal long, received_ms long, route string, payload string").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("session_id string, producer_id string, ordinal long, received_ms long, route string, payload string").parquet(f"{tmp_path}/in")
    limits = AssemblerLimits(heartbeat_deadline_ms=1_500, frame_deadline_ms=60_000)
    q = assembled(stream, limits).writeStream.format("memory").queryName("silence").outputMode("append").trigger(processingTime="500 milliseconds").start()
    try:
        until = time.time() + 60
        while time.time() < until and not spark.table("silence").filter("kind = 'fault'").count():
            time.sleep(0.5)
        assert [r.detail for r in spark.table("silence").filter("kind = 'fault'").collect()] == ["heartbeat_deadline"]
    finally:
        q.stop()


def test_assembly_stream(spark, tmp_path):
    items = [*[("monitor", e) for e in frame_events()], ("observation", OBS)]
    rows = [("s", p, i, 10 + i, route, json.dumps(x)) for p in ("a", "b") for i, (route, x) in enumerate(items) if not (p == "b" and i == 1)]
    df = spark.createDataFrame(rows, "session_id string, producer_id string, ordinal int, received_ms long, route string, payload string")
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    slow = AssemblerLimits(frame_deadline_ms=10**7, reorder_deadline_ms=10**7, heartbeat_deadline_ms=10**7, initial_deadline_ms=10**7)
    got = run(spark, assembled(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), slow), "a", timers=True)
    assert sorted((r.producer_id, r.kind) for r in got) == [("a", "frame"), ("a", "heartbeat"), ("b", "heartbeat")]


BAD = [
    ("monitor", "{"), ("monitor", None), ("monitor", "[]"), ("monitor", "NaN"), ("monitor", '{"event_seq": 0, "event_seq": 0}'), (None, "{}"), ("other", "{}"),
    ("monitor", '{"event_seq": "0", "type": "heartbeat", "data": {}}'), ("monitor", '{"event_seq": 0, "type": "frame_summary", "data": {}}'),
    ("monitor", '{"event_seq": 0, "type": "modality_outcome", "data": null}'), ("monitor", '{"event_seq": true, "type": "heartbeat", "data": {}}'),
    ("observation", '{"seq": 1, "track_id": 1, "modality": 3, "timestamp_ms": 5}'), ("observation", '{"seq": -1, "track_id": 1, "modality": "x", "timestamp_ms": 5}'),
    ("observation", '{"seq": Infinity}'), ("monitor", "[" * 60_000), ("observation", '"' + "x" * 70_000 + '"'),
]


@pytest.mark.parametrize(("route", "payload"), BAD)
def test_bad_payloads_are_faults(route, payload):
    machine = Assembler()
    (told,) = machine.receive(route, payload, 10)
    assert told["kind"] == "fault" and told["detail"] in ("malformed_payload", "invalid_envelope", "payload_too_large")
    assert machine.receive("observation", json.dumps(OBS), 11) == []
    assert Assembler(saved=machine.save()).fault == machine.fault


def test_a_bad_payload_ends_its_key_alone(spark, tmp_path):
    items = [*[("monitor", e) for e in frame_events()], ("observation", OBS)]
    rows = [("s", p, i, 10 + i, route, json.dumps(x)) for p in ("a", "b", "c") for i, (route, x) in enumerate(items)]
    rows = [(*r[:5], "{") if r[1] == "b" and r[2] == 2 else (*r[:3], None, *r[4:]) if r[1] == "c" and r[2] == 3 else r for r in rows]
    df = spark.createDataFrame(rows, "session_id string, producer_id string, ordinal int, received_ms long, route string, payload string")
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    slow = AssemblerLimits(frame_deadline_ms=10**7, reorder_deadline_ms=10**7, heartbeat_deadline_ms=10**7, initial_deadline_ms=10**7)
    got = run(spark, assembled(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), slow), "bad", timers=True)
    told = sorted((r.producer_id, r.kind, r.detail if r.kind == "fault" else "") for r in got)
    assert told == [("a", "frame", ""), ("a", "heartbeat", ""), ("b", "fault", "malformed_payload"), ("b", "heartbeat", ""), ("c", "frame", ""), ("c", "heartbeat", "")]
