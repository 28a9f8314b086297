import json

import pytest

from accordant.config import JsonlLimits
from accordant.sources import jsonl

GOOD = {"track_id": 10, "timestamp_ms": 100, "seq": 1, "modality": "radar", "nis": 3.0, "dof": 3}
PROJECTED = GOOD | {"seq": 2, "timestamp_ms": 200, "consistency_projection": {"values": [0.5, 0.0, 0.0], "dimensions": 1, "frame_id": 1, "context_id": 1, "prior_id": 3}}


def reasons(spark, tmp_path, lines):
    (tmp_path / "in.jsonl").write_text("\n".join(lines) + "\n")
    rows = jsonl.channel_guard(jsonl.scan(spark, str(tmp_path / "in.jsonl"), JsonlLimits(max_line_bytes=600))).orderBy("position").collect()
    return [r.reject_reason for r in rows]


def test_each_line_is_judged(spark, tmp_path):
    cases = [
        (json.dumps(GOOD), None), (json.dumps(PROJECTED) + "\r", None), (json.dumps(GOOD), "sequence_not_increasing"), ("", "blank_line"), ("{", "not_json"), ("[1]", "not_json"), (json.dumps(GOOD | {"extra": 1}), "keys"),
        (json.dumps(GOOD)[:-1] + ', "nis": 4.0}', "keys"), (json.dumps({k: v for k, v in GOOD.items() if k != "dof"}), "keys"), (json.dumps(GOOD | {"seq": 3, "nis": -1.0}), "nis_negative"), (json.dumps(GOOD | {"seq": 3, "modality": "sonar"}), "unknown_modality"),
        (json.dumps(GOOD | {"seq": 2**53}), "sequence_out_of_range"), (json.dumps(PROJECTED | {"seq": 4, "consistency_projection": PROJECTED["consistency_projection"] | {"values": [0.5, 1.0, 0.0]}}), "projection_inactive_axis"),
        (json.dumps(PROJECTED | {"seq": 4, "consistency_projection": {"values": [0, 0, 0]}}), "projection_keys"), (json.dumps(GOOD | {"seq": 5, "innovation": [1, 2, 3]}), "innovation_unpaired"), (json.dumps(GOOD) + " " * 700, "line_too_long"), (json.dumps(GOOD).replace("3.0", "NaN"), "not_json"),
        (json.dumps(GOOD | {"seq": 9}), None),
    ]
    assert reasons(spark, tmp_path, [c[0] for c in cases]) == [c[1] for c in cases]


def test_round_trip_and_limits(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("".join(json.dumps(x) + "\n" for x in (GOOD, PROJECTED)))
    rows = jsonl.read_jsonl(spark, str(tmp_path / "a.jsonl"))
    jsonl.write_jsonl(rows, str(tmp_path / "out"))
    again = jsonl.read_jsonl(spark, str(tmp_path / "out"))
    assert sorted(map(str, again.collect())) == sorted(map(str, rows.collect()))
    for limits in (JsonlLimits(max_records=1), JsonlLimits(max_total_bytes=100, max_line_bytes=100), JsonlLimits(max_streams=1, max_records=2)):
        if limits.max_streams == 1 and limits.max_records == 2:
            assert jsonl.read_jsonl(spark, str(tmp_path / "a.jsonl"), limits).count() == 2
            continue
        with pytest.raises(ValueError):
            jsonl.read_jsonl(spark, str(tmp_path / "a.jsonl"), limits)
    bad = rows.withColumn("nis", -rows.nis)
    with pytest.raises(ValueError, match="nis_negative"):
        jsonl.write_jsonl(bad, str(tmp_path / "bad"))
    assert not (tmp_path / "bad").exists()


def test_envelopes(spark):
    e = {"kind": "observation", "schema_version": "1", "ncp_version": "0.9", "contract_hash": "ab", "session_id": "s-1", "producer_id": "p.1", "observation": GOOD}
    cases = [(e, None), (e | {"session_id": "other"}, "wrong_session"), (e | {"session_id": "-bad"}, "session_identity"), (e | {"kind": "x"}, "kind"), (e | {"contract_hash": "cd"}, "contract_hash"), (e | {"observation": GOOD | {"dof": 0}}, "dof_out_of_range"), (e | {"more": 1}, "keys"), (e | {"observation": GOOD | {"more": 1}}, "observation_keys")]
    lines = spark.createDataFrame([(i, json.dumps(x)) for i, (x, _) in enumerate(cases)], "n int, line string")
    got = jsonl.envelopes(lines, "observation", "1", contract_hash="ab", session_id="s-1", producer_id="p.1").orderBy("n").collect()
    assert [r.reject_reason for r in got] == [want for _, want in cases]


def test_topics():
    assert jsonl.topic("site/a", "s1", "observations") == "site/a/session/s1/observations"
    with pytest.raises(ValueError):
        jsonl.topic("site//a", "s1", "x")
