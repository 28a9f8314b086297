import dataclasses
import hashlib
import struct

import pytest

from accordant.config import CorrelationConfig, DetectorConfig
from accordant.operators import identity
from accordant.schema import CODES

SCHEMA = (
    "track_id long, timestamp_ms long, seq long, modality string, code int, nis double, dof int, "
    "p0 double, p1 double, p2 double, frame_id long, context_id long, prior_id long"
)
BASE = (1, 100, 7, "visual", 0, 3.0, 3, None, None, None, None, None, None)
FULL = (*BASE[:7], 0.4, -0.5, 0.0, 1, 2, 3)
SUITE = identity.suite_digest((DetectorConfig(), CorrelationConfig()), ("visual", "radar"))


def record(domain, *told):
    """Plain bytes of a record: its domain, then name, type and value of each field."""
    size = lambda x: len(x).to_bytes(8, "big")
    out = size("accordant-identity-v1") + b"accordant-identity-v1" + b"\x04" + size(domain) + domain.encode()
    for name, kind, value in told:
        raw = {1: lambda v: bytes([v]), 2: lambda v: v.to_bytes(8, "big"), 3: lambda v: struct.pack(">d", v + 0.0), 5: bytes.fromhex}[kind](value)
        out += size(name) + name.encode() + bytes([kind]) + size(raw) + raw
    return out


def plain(rows, fan_out):
    digests = []
    for track, stamp, seq, modality, _, nis, dof, *projection in sorted(rows, key=lambda r: (r[2], r[4], r[1], r[6], r[5])):
        fields = [("track_id", 2, track), ("timestamp_ms", 2, stamp), ("seq", 2, seq), ("modality", 1, CODES[modality] + 1), ("nis", 3, nis), ("dof", 1, dof)]
        there = projection[0] is not None
        fields.append(("projection", 1, int(there)))
        if there:
            names = ("p0", "p1", "p2", "frame_id", "context_id", "prior_id")
            fields += [(n, 3 if n[0] == "p" and len(n) == 2 else 2, v) for n, v in zip(names, projection, strict=True)]
        digests.append(hashlib.sha256(record("observation", *fields)).hexdigest())
    for level in range(3):
        width = fan_out if level < 2 else max(1, len(digests))
        parts = [digests[i : i + width] for i in range(0, len(digests), width)]
        digests = [hashlib.sha256(record(f"level-{level}", ("count", 2, len(p))) + bytes.fromhex("".join(p))).hexdigest() for p in parts]
    return hashlib.sha256(record("binding", ("suite", 5, SUITE), ("observations", 2, len(rows)), ("tree", 5, digests[0]))).hexdigest()


def binding(spark, rows, suite=SUITE):
    return {r.track_id: (r.observations, r.binding) for r in identity.bindings(spark.createDataFrame(rows, SCHEMA).repartition(3), suite).collect()}


@pytest.mark.parametrize("fan_out", [2, 3, 1_024])
def test_equals_plain_bytes(spark, monkeypatch, fan_out):
    monkeypatch.setattr(identity, "FAN_OUT", fan_out)
    rows = [(t, 100 * i + c, i, m, c, 0.1 * i * c, 3, *(FULL[7:] if i % 3 else BASE[7:])) for t in (1, 2) for i in range(9) for m, c in (("visual", 0), ("radar", 3))]
    assert binding(spark, rows) == {t: (18, plain([r for r in rows if r[0] == t], fan_out)) for t in (1, 2)}


def test_every_field_and_the_order_count(spark):
    changes = [(0, 2), (1, 101), (2, 8), (3, "radar"), (5, 3.125), (6, 2), (7, 0.25), (8, 0.5), (9, 1.0), (10, 9), (11, 9), (12, 9)]
    told = {binding(spark, [FULL]).popitem()[1][1], binding(spark, [BASE]).popitem()[1][1], binding(spark, [FULL], identity.suite_digest((), ())).popitem()[1][1]}
    for at, value in changes:
        told.add(binding(spark, [(*FULL[:at], value, *FULL[at + 1 :])]).popitem()[1][1])
    assert len(told) == len(changes) + 3
    assert binding(spark, [(*FULL[:9], -0.0, *FULL[10:])]) == binding(spark, [FULL])
    assert binding(spark, [FULL, FULL])[1][0] == 2 and binding(spark, []) == {}
    assert binding(spark, [FULL, (*FULL[:5], None, *FULL[6:])])[1] == (2, None)


def test_config_digests_tell_every_parameter():
    base = DetectorConfig()
    told = {identity.config_digest(base), identity.config_digest(CorrelationConfig())}
    changed = dict(window_len=65, min_samples=31, max_seq_gap=2, max_timestamp_skew_ms=1, nis_alpha=0.02, cusum_slack=1.0, cusum_threshold=9.0, jam_fraction=0.5)
    told |= {identity.config_digest(dataclasses.replace(base, **{k: v})) for k, v in changed.items()}
    assert len(told) == len(changed) + 2 and identity.config_digest(DetectorConfig()) in told


def test_mixed_bindings_are_no_evidence(spark):
    told = spark.createDataFrame([(1, "aa"), (2, "bb")], "track_id long, binding string")
    rows = spark.createDataFrame([(1, 5, "intact"), (2, 5, "decoupled"), (3, 5, "intact")], "track_id long, seq long, state string")
    one, two = identity.bound(rows, told), identity.bound(rows, told.replace("bb", "cc", subset="binding"))
    got = {r.track_id: (r.provenance, r.state_0, r.state_1) for r in identity.combined([one, two], ("track_id", "seq"), ("state",)).collect()}
    assert got == {1: ("one", "intact", "intact"), 2: ("mismatched", None, None), 3: ("mismatched", None, None)}
