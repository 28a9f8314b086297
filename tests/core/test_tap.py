import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from accordant.streaming.tap import Tap, TapConfig

GOOD = {"track_id": 10, "timestamp_ms": 100, "seq": 1, "modality": "radar", "nis": 3.0, "dof": 3}
ENVELOPE = {"kind": "observation", "schema_version": "1", "ncp_version": "0.9", "contract_hash": "ab", "session_id": "s-1", "producer_id": "p.1"}
CFG = TapConfig("observation", "1", "ab", "s-1", "p.1", max_payload_bytes=2_000, max_streams=3, max_forward_gap=5)
SCHEMA = "ordinal long, payload string, control string"


def payload(seq, track=10, modality="radar", **other):
    told = GOOD | {"seq": seq, "track_id": track, "modality": modality, "timestamp_ms": 100 + seq}
    return json.dumps(ENVELOPE | {"observation": told} | other)


def plain(rows, cfg=CFG):
    """Row by row, from the rules; malformed payloads are those that the rows below make."""
    marks, out = {}, {}
    for ordinal, text, control in sorted(rows):
        if control is not None:
            out[ordinal] = "reset" if control == "reset" else "unknown_control"
            if control == "reset":
                marks = {}
            continue
        if text is not None and len(text) > cfg.max_payload_bytes:
            out[ordinal] = "payload_too_large"
            continue
        try:
            e = json.loads(text)
            o = e["observation"]
        except (TypeError, ValueError):
            out[ordinal] = "malformed_json"
            continue
        if e["session_id"] != "s-1":
            out[ordinal] = "provenance_mismatch"
        elif e["schema_version"] != "1":
            out[ordinal] = "invalid_envelope"
        elif o["nis"] < 0:
            out[ordinal] = "invalid_observation"
        else:
            key, last = (o["track_id"], o["modality"]), marks.get((o["track_id"], o["modality"]))
            if last is None and len(marks) >= cfg.max_streams:
                out[ordinal] = "sequence_capacity_exceeded"
            elif last is not None and o["seq"] <= last:
                out[ordinal] = "duplicate_or_regressed_sequence"
            elif last is not None and o["seq"] - last > cfg.max_forward_gap:
                out[ordinal] = "excessive_forward_sequence_gap"
            else:
                out[ordinal], marks[key] = "accepted", o["seq"]
    return out


def rows_of(n, seed):
    rng, rows, at = random.Random(seed), [], Counter()
    for ordinal in range(n):
        track = rng.choice([10, 10, 10, 11, 12, 13])
        at[track] += rng.choice([1, 1, 1, 2, 0, -2, 9]) if rng.random() < 0.9 else 1
        text = payload(max(0, at[track]), track)
        kind = rng.random()
        if kind < 0.04:
            text = rng.choice(["{", None, "[]x", text[:-3]])
        elif kind < 0.07:
            text = payload(max(0, at[track]), track, session_id="other")
        elif kind < 0.09:
            text = payload(max(0, at[track]), track, schema_version="2")
        elif kind < 0.11:
            text = text.replace("3.0", "-3.0")
        elif kind < 0.13:
            text += " " * 3_000
        control = rng.choice(["reset", "reset", "stop"]) if rng.random() < 0.02 else None
        rows.append((ordinal, None if control else text, control))
    return rows


def told(spark, tap):
    refused = {r.ordinal: r.reason for r in tap.read(spark, "dead").collect()}
    return refused | {r.ordinal: "accepted" for r in tap.read(spark, "accepted").collect()}


def test_every_payload_is_told_once_over_restarts(spark, tmp_path):
    """Bad payloads are counted and the stream goes on; marks outlive a restart, and a batch that runs again changes nothing."""
    rows = rows_of(420, 3)
    want = {k: v for k, v in plain(rows).items() if v != "reset"}
    assert len(set(want.values())) == 10
    tap = Tap(f"file://{tmp_path}/tap", CFG)
    for n, cut in enumerate((rows[:150], rows[150:290], rows[290:])):
        spark.createDataFrame(cut, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
        query = tap.start(stream, f"{tmp_path}/checkpoint", availableNow=True)
        query.awaitTermination(120)
        assert told(spark, tap) == {k: v for k, v in want.items() if k <= cut[-1][0]}, n
    before = told(spark, tap)
    tap.take(spark.createDataFrame(rows[290:], SCHEMA), 2)
    assert told(spark, tap) == before and tap.read(spark, "accepted").count() == sum(v == "accepted" for v in want.values())
    assert {r.state: r.n for r in tap.health(spark).collect()} == dict(Counter(plain(rows).values()))


def test_a_reset_forgets_marks_and_makes_room(spark, tmp_path):
    tap = Tap(f"file://{tmp_path}/tap", CFG)
    tap.begin(spark)
    first = [(i, payload(50, t), None) for i, t in enumerate((1, 2, 3, 4))]
    second = [(10, payload(1, 1), None), (11, None, "reset"), (12, payload(1, 1), None), (13, payload(1, 4), None), (14, payload(2, 1), None)]
    tap.take(spark.createDataFrame(first, SCHEMA), 0)
    tap.take(spark.createDataFrame(second, SCHEMA), 1)
    tap.take(spark.createDataFrame([(20, payload(7, 1), None), (21, payload(7, 2), None)], SCHEMA), 2)
    tap.take(spark.createDataFrame([], SCHEMA), 3)
    tap.take(spark.createDataFrame([(30, payload(8, 1), None)], SCHEMA), 4)
    assert told(spark, tap) == {
        0: "accepted", 1: "accepted", 2: "accepted", 3: "sequence_capacity_exceeded", 10: "duplicate_or_regressed_sequence", 12: "accepted",
        13: "accepted", 14: "accepted", 20: "accepted", 21: "accepted", 30: "accepted",
    }


def test_an_unfinished_batch_is_not_seen(spark, tmp_path):
    tap = Tap(f"file://{tmp_path}/tap", CFG)
    tap.begin(spark)
    tap.take(spark.createDataFrame([(0, payload(1), None)], SCHEMA), 0)
    spark.createDataFrame([(1,)], "ordinal long").withColumn("epoch", F.lit(0)).write.parquet(f"{tmp_path}/tap/accepted/batch=1")
    assert [r.ordinal for r in tap.read(spark, "accepted").collect()] == [0]
    with pytest.raises(ValueError):
        TapConfig("observation", "1", max_streams=0)
