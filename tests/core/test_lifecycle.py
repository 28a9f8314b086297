import json
import shutil
from collections import Counter
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from accordant import views
from accordant.config import CorrelationConfig, DetectorConfig
from accordant.operators import fusion
from accordant.streaming.lifecycle import FRAME, LANE, Lane, LifecycleLimits, assessed, published, receipts, verified

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
MODS = ["visual", "acoustic", "radar"]
DETECTOR, CORR = DetectorConfig(window_len=16, min_samples=8), CorrelationConfig(window=24, min_samples=16)
LIMITS = LifecycleLimits(history_frames=40)


def row(seq, generation=0, epoch="e1", kind="frame", at=None, tracks=(7,), nis=3.0, mods=MODS, **other):
    at = 1_000 + 100 * seq if at is None else at
    place = {"kind": kind, "epoch_id": epoch, "generation": generation, "seq": seq, "timestamp_ms": at, "clock": "producer"}
    if kind != "frame":
        return place | other
    ids = {"frame_id": 1, "context_id": 1, "prior_id": seq + 1} | {k: other[k] for k in ("frame_id", "context_id") if k in other}
    seen = [{"track_id": t, "modality": m, "seq": seq, "timestamp_ms": at, "dof": 3, "nis": nis, "p0": 0.1 * seq, "p1": 0.2, "p2": 0.3} | ids for t in tracks for m in mods]
    return place | ids | {"registry_digest": "r", "modalities": list(mods), "frozen": list(tracks), "observations": seen} | other


def run(*rows, limits=LIMITS):
    lane = Lane(("p", "s", "cam"), DETECTOR, CORR, limits)
    out = [lane.offer(r, json.dumps(r)) for r in rows]
    return [None if r is None else json.loads(r["transition"]) for r in out], lane, out


def why(*rows, **more):
    return run(*rows, **more)[0][-1]["reason"]


def test_positions_follow_one_another():
    told, lane, _ = run(
        row(0), row(1), row(2, 1), row(3, 2, context_id=2), row(4, 3, "e1", "timeout"), row(5, 3, context_id=2),
        row(0, 0, "e2", "rollover", at=5), row(1, 0, "e2"), row(0, 0, "e3"), row(1, 0, "e3", at=99_000), row(2, 0, "e3"),
    )
    kinds = [t and t["kind"] for t in told]
    assert kinds == ["initialize", "advance", "reset", "reset", "reset", "advance", "rollover", "advance", "rollover", "rejected", None]
    assert [t.get("reasons") for t in told[2:5]] == [["explicit"], ["projection_context"], ["timeout"]]
    assert lane.fault == "missing_reset:inter_sample_deadline" and lane.index == 10


@pytest.mark.parametrize(
    "rows, reason",
    [
        ([row(0, 1)], "state_generation_mismatch"),
        ([row(1), row(1)], "duplicate"),
        ([row(1), row(1, nis=4.0)], "conflicting_replay"),
        ([row(1), row(2), row(1)], "replay"),
        ([row(1), row(0)], "reordered"),
        ([row(0), row(2)], "forward_sequence_gap"),
        ([row(0), row(1, at=1_000)], "non_increasing_timestamp"),
        ([row(0), row(1) | {"clock": "wall"}], "clock_domain_changed"),
        ([row(0), row(1, context_id=2)], "missing_reset:projection_context"),
        ([row(0), row(1, frame_id=3, registry_digest="q")], "missing_reset:projection_frame,projection_registry"),
        ([row(0), row(1, mods=MODS[:2])], "missing_reset:expected_modalities"),
        ([row(0), row(1, 2)], "state_generation_mismatch"),
        ([row(0), row(1, 0, "e2")], "invalid_rollover_origin"),
        ([row(0), row(0, 0, "e2"), row(0, 0, "e1")], "reused_epoch"),
        ([row(0, kind="rollover", epoch="e2")], "unknown_stream"),
        ([row(0), row(1, 0, kind="reset")], "invalid_reset_successor"),
        ([row(0), row(1, 1, kind="stop")], "unknown_kind"),
        ([row(0, mods=MODS[::-1])], "modalities_not_canonical"),
        ([row(0, mods=MODS[:1])], "too_few_modalities"),
        ([row(0) | {"frozen": [8]}], "track_not_frozen"),
        ([row(0) | {"modalities": MODS[:2]}], "unexpected_modality"),
        ([row(0) | {"prior_id": 5}], "projection_provenance"),
        ([row(0, nis="NaN")], "invalid_value"),
        ([{k: v for k, v in row(0).items() if k != "seq"}], "invalid_position"),
    ],
)
def test_what_breaks_a_rule_closes_the_lane(rows, reason):
    assert why(*rows) == reason
    told, lane, _ = run(*rows, row(9))
    assert told[-1] is None and lane.fault == reason and not lane.tracks


def test_bounds():
    frames = [row(i) for i in range(6)]
    assert why(*frames, row(1), limits=replace(LIMITS, recent_frames=3)) == "reordered"
    assert why(*frames, row(3), limits=replace(LIMITS, recent_frames=3)) == "replay"
    assert why(row(0), row(0, 0, "e2"), row(0, 0, "e3"), limits=replace(LIMITS, max_epochs=2)) == "epoch_capacity"
    _, lane, _ = run(*frames, limits=replace(LIMITS, history_frames=4))
    assert len(lane.tracks[7]) == 4
    with pytest.raises(ValueError):
        LifecycleLimits(history_frames=0)


def test_tracks_without_a_projection_abstain_and_begin_anew():
    def without(r):
        return r | {"observations": [{k: v for k, v in o.items() if k != "p0"} if o["modality"] == "radar" and o["track_id"] == 7 else o for o in r["observations"]]}

    _, lane, out = run(row(0, tracks=(7, 8)), without(row(1, tracks=(7, 8))), row(2, tracks=(7, 8)), row(3, tracks=(8,)), row(4, tracks=()))
    told = [json.loads(r["assessments"]) for r in out]
    assert told[1][0] == {"track_id": 7, "seq": 1, "abstained": ["radar"]} and told[1][1]["history_reset"] is False
    assert [t["history_reset"] for t in told[2]] == [True, False] and [t["track_id"] for t in told[3]] == [8] and told[4] == [] and not lane.tracks


def frames_of(spark, sf_dir, most):
    """Frames of the scenario, a lane a track, with rows that reset, time out, roll over and break rules."""
    o = views.scenario(spark, sf_dir).filter(F.col("seq") < most).withColumn("timestamp_ms", F.col("seq") * 100)
    ids = ["frame_id", "context_id", "prior_id"]
    names = ["track_id", "modality", "seq", "timestamp_ms", "dof", "nis", "p0", "p1", "p2", *ids]
    one = o.groupBy("track_id", "seq").agg(F.first("timestamp_ms").alias("timestamp_ms"), *(F.first(c).alias(c) for c in ids), F.collect_list(F.struct(*names)).alias("observations"))
    return one.select(
        F.lit("p").alias("producer_id"), F.lit("s").alias("session_id"), F.concat(F.lit("cam"), "track_id").alias("stream_id"), F.col("seq").alias("arrival"), F.lit("frame").alias("kind"),
        F.lit("e1").alias("epoch_id"), F.lit(0).cast("long").alias("generation"), "seq", "timestamp_ms", F.lit("producer").alias("clock"), *ids, F.lit("r").alias("registry_digest"),
        F.array(*map(F.lit, MODS)).alias("modalities"), F.array("track_id").alias("frozen"), "observations",
    )


def test_stream_equals_batch_and_its_chain_outlives_restarts(spark, tmp_path):
    sf, most = "/root/testdata/sf0.001", 40
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    rows = frames_of(spark, sf, most)
    schema = ", ".join(f"{c} string" for c in LANE) + ", arrival bigint, " + FRAME
    given, log, checkpoint = tmp_path / "in", str(tmp_path / "log"), tmp_path / "checkpoint"
    given.mkdir()

    def put(part, name):
        part.coalesce(1).write.json(str(tmp_path / name))
        shutil.copy(next((tmp_path / name).glob("*.json")), given / f"{name}.json")

    def go():
        told = receipts(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(given)), DETECTOR, CORR, LIMITS)
        query = published(told, log, str(checkpoint), availableNow=True)
        assert query.awaitTermination(300)

    put(rows.filter(F.col("seq") < 15), "a")
    go()
    put(rows.filter(F.col("seq").between(15, 29)), "b")
    go()
    # The last batch was published, but its commit is lost: it runs again.
    done = max((int(p.name) for p in (checkpoint / "commits").iterdir() if p.name.isdigit()))
    for p in (checkpoint / "commits").glob(f"*{done}*"):
        p.unlink()
    put(rows.filter(F.col("seq") >= 30), "c")
    again = rows.filter((F.col("seq") == 20) & (F.col("stream_id") == "cam0")).withColumn("arrival", F.lit(10_000).cast("long"))
    put(again, "d")
    go()
    told = spark.read.parquet(log)
    assert verified(told).filter("fault IS NOT NULL").count() == 0
    lanes = rows.select("stream_id").distinct().count()
    kinds = Counter(r["kind"] for r in told.select(F.get_json_object("transition", "$.kind").alias("kind")).collect())
    assert kinds == {"initialize": lanes, "advance": lanes * (most - 1), "rejected": 1}
    # The whole history fits, so each verdict is that of the batch plan.
    names = "track_id bigint, seq bigint, fused_verdict string, fused_channels string, magnitude_verdict string, consistency_status string"
    live = told.filter("assessments IS NOT NULL").select(F.explode(F.from_json("assessments", f"array<struct<{names.replace(' bigint', ': bigint').replace(' string', ': string')}>>")).alias("a")).select("a.*")
    batch = fusion.assessed_frames(views.scenario(spark, sf).filter(F.col("seq") < most).withColumn("timestamp_ms", F.col("seq") * 100), tuple(MODS), DETECTOR, CORR).select(*live.columns)
    assert Counter(map(tuple, live.collect())) == Counter(map(tuple, batch.collect())) and batch.select("fused_verdict").distinct().count() > 1
    # Damage of any kind is told.
    at = (F.col("stream_id") == "cam0") & (F.col("index") == 3)
    for column, fault in (("frame_digest", "digest"), ("assessments", "assessments"), ("stream_id", "place")):
        bad = told.withColumn(column, F.when(at, "00").otherwise(F.col(column)))
        assert fault in {r.fault for r in verified(bad).filter("fault IS NOT NULL").collect()}
    gone = verified(told.filter(~at)).filter("fault IS NOT NULL").collect()
    assert {(r["index"], r.fault) for r in gone} == {(4, "index")}


def test_history_is_all_that_counts():
    frames = [[o for o in row(i, nis=90.0 if i < 10 else 3.0)["observations"]] for i in range(40)]
    told = assessed(frames[-20:], tuple(MODS), DETECTOR, CORR)
    assert told["magnitude_verdict"] == "nominal"
