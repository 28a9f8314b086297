"""Two-route assembly: monitor events in total order joined with observations into frames, with deadlines and a latched fault.

The state machine is plain Python, so it can be tested call by call; the
stream wrapper keys it by (session_id, producer_id) and keeps it as JSON. An
observation may come before or after its ledger entry; the join is checked on
whichever arrives second. A fault ends the stream of its key: later input gives
nothing. A late observation is a fault, not a drop. Silence is one too: each
key has a timer for its next deadline, so a producer that goes quiet faults
without any further row.

State has bounds: what is pending, open frames and observation streams have
limits whose breach is a fault, and of the priors of finalised frames the newest
``max_priors`` are remembered.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from accordant.streaming.registries import Registries, Violation, check_events, check_summary, held


@dataclass(frozen=True)
class AssemblerLimits:
    max_reorder_distance: int = 64
    max_pending_events: int = 1_024
    max_open_frames: int = 64
    max_frame_events: int = 4_096
    max_observation_streams: int = 8_192
    max_priors: int = 65_536
    max_payload_bytes: int = 64 * 1024
    frame_deadline_ms: int = 5_000
    reorder_deadline_ms: int = 1_000
    heartbeat_deadline_ms: int = 3_000
    initial_deadline_ms: int = 30_000

    def __post_init__(self) -> None:
        if min(asdict(self).values()) < 1:
            raise ValueError("limits and deadlines are at least 1")


@dataclass
class Frame:
    opened_at: int
    identity: list | None = None  # timestamp, frame, context, prior
    events: list[dict] = field(default_factory=list)
    observations: dict[str, dict] = field(default_factory=dict)  # by "track/modality"
    summary: dict | None = None
    expected: dict[str, object] = field(default_factory=dict)


class Fault(Exception):
    pass


_WHOLE, _TEXT = "whole", "text"
_IDENTITY = {"fusion_seq": _WHOLE, "fusion_timestamp_ms": _WHOLE, "frame_id": _WHOLE, "context_id": _WHOLE, "prior_id": _WHOLE}
#: What the machine reads of each kind of payload, and of which type it must be.
_COUNTS = ("attempt_index", "candidate_count", "measurement_index", "active_track_count", "input_count", "queue_capacity")
_OBSERVATION = {"seq": _WHOLE, "track_id": _WHOLE, "timestamp_ms": _WHOLE, "modality": _TEXT}
_SUMMARY = _IDENTITY | {"outcome_count": _WHOLE, "v1_expected_count": _WHOLE}
_OUTCOME = _IDENTITY | {"track_id": _WHOLE, "modality": _TEXT}


def _has(d: object, fields: dict[str, str]) -> bool:
    def sound(x: object, kind: str) -> bool:
        return isinstance(x, str) if kind == _TEXT else isinstance(x, int) and not isinstance(x, bool) and x >= 0

    return isinstance(d, dict) and all(sound(d.get(k), kind) for k, kind in fields.items())


def is_envelope(route: object, e: object) -> bool:
    """Whether a payload has what its route asks for."""
    if route == "observation":
        return _has(e, _OBSERVATION)
    if route != "monitor" or not _has(e, {"event_seq": _WHOLE, "type": _TEXT}) or not isinstance(e.get("data"), dict):
        return False
    d = e["data"]
    if any(d.get(c) is not None and not _has(d, {c: _WHOLE}) for c in _COUNTS):
        return False
    if e["type"] == "heartbeat":
        return d.get("last_fusion_seq") is None or _has(d, {"last_fusion_seq": _WHOLE})
    if e["type"] != "frame_summary":
        return _has(d, _OUTCOME)
    names = d.get("expected_modalities")
    return _has(d, _SUMMARY) and isinstance(names, list) and all(isinstance(m, str) for m in names)


def decoded(payload: object, limits: AssemblerLimits) -> object:
    """A payload's JSON, strictly: no repeated keys, no NaN. Raises Fault."""

    def once(pairs: list[tuple[str, object]]) -> dict:
        if len({k for k, _ in pairs}) < len(pairs):
            raise ValueError("repeated key")
        return dict(pairs)

    def no_number(text: str) -> object:
        raise ValueError(f"{text} is no JSON number")

    if not isinstance(payload, str):
        raise Fault("malformed_payload")
    if len(payload.encode("utf-8", "surrogatepass")) > limits.max_payload_bytes:
        raise Fault("payload_too_large")
    try:
        return json.loads(payload, object_pairs_hook=once, parse_constant=no_number)
    except (ValueError, RecursionError):
        raise Fault("malformed_payload") from None


class Assembler:
    """One (session, producer)."""

    def __init__(self, limits: AssemblerLimits | None = None, saved: str | None = None, registries: Registries | None = None):
        self.limits = limits or AssemblerLimits()
        self.registries = registries
        d = json.loads(saved) if saved else {}
        self.next_event = d.get("next_event", 0)
        self.pending = {int(k): v for k, v in d.get("pending", {}).items()}
        self.frames = {int(k): Frame(**v) for k, v in d.get("frames", {}).items()}
        self.priors = {int(k): v for k, v in d.get("priors", {}).items()}
        self.high_water = d.get("high_water", {})
        self.finalised = d.get("finalised", -1)
        self.last_summary = d.get("last_summary", -1)
        self.heartbeat_at = d.get("heartbeat_at")
        self.started_at = d.get("started_at")
        self.gap_since = d.get("gap_since")
        self.fault = d.get("fault")
        self.registry_digest = d.get("registry_digest")
        self.registry_version = d.get("registry_version", -1)

    def save(self) -> str:
        kept = {k: v for k, v in vars(self).items() if k not in ("limits", "registries")}
        return json.dumps(kept | {"frames": {n: asdict(f) for n, f in self.frames.items()}})

    def offer(self, route: str, payload: dict, now: int) -> list[dict]:
        """Monitor events carry event_seq, type and data; observations their fields. Gives frames, heartbeats and at most one fault."""
        if self.fault:
            return []
        out: list[dict] = []
        try:
            self._deadlines(now)
            self.started_at = now if self.started_at is None else self.started_at
            if not is_envelope(route, payload):
                raise Fault("invalid_envelope")
            out = self._monitor(payload, now) if route == "monitor" else self._observation(payload, now)
        except (Fault, Violation) as fault:
            out = self._fail(str(fault))
        return out

    def receive(self, route: object, payload: object, now: int) -> list[dict]:
        """``offer`` of a payload as JSON text; what can't be read is a fault of this key, and of no other."""
        if self.fault:
            return []
        try:
            told = decoded(payload, self.limits)
        except Fault as fault:
            return self._fail(str(fault))
        return self.offer(route, told, now)

    def advance(self, now: int) -> list[dict]:
        """Deadlines alone; at or after the deadline counts as expired."""
        if self.fault:
            return []
        try:
            self._deadlines(now)
        except Fault as fault:
            return self._fail(str(fault))
        return []

    def next_deadline(self) -> int | None:
        """When ``advance`` would fault if nothing came before; null without a deadline, as before any row or after a fault."""
        lim = self.limits
        if self.fault or self.started_at is None:
            return None
        beat = self.started_at + lim.initial_deadline_ms if self.heartbeat_at is None else self.heartbeat_at + lim.heartbeat_deadline_ms
        gap = [] if self.gap_since is None else [self.gap_since + lim.reorder_deadline_ms]
        return min([beat, *gap, *(f.opened_at + lim.frame_deadline_ms for f in self.frames.values())])

    def _fail(self, why: str) -> list[dict]:
        # What was staged in the same call is given up: a fault discards it.
        first = min(self.frames, default=self.finalised + 1)
        self.fault = why
        self.pending, self.frames = {}, {}
        return [{"kind": "fault", "fusion_seq": first, "detail": why}]

    def _deadlines(self, now: int) -> None:
        lim = self.limits
        if self.started_at is not None and self.heartbeat_at is None and now - self.started_at >= lim.initial_deadline_ms:
            raise Fault("initial_heartbeat_deadline")
        if self.heartbeat_at is not None and now - self.heartbeat_at >= lim.heartbeat_deadline_ms:
            raise Fault("heartbeat_deadline")
        if self.gap_since is not None and now - self.gap_since >= lim.reorder_deadline_ms:
            raise Fault("reorder_deadline")
        if any(now - f.opened_at >= lim.frame_deadline_ms for f in self.frames.values()):
            raise Fault("frame_deadline")

    def _monitor(self, e: dict, now: int) -> list[dict]:
        seq = e["event_seq"]
        if seq < self.next_event or seq in self.pending:
            raise Fault("event_duplicate_or_regressed")
        if seq - self.next_event > self.limits.max_reorder_distance:
            raise Fault("event_distance")
        if len(self.pending) >= self.limits.max_pending_events:
            raise Fault("event_capacity")
        self.pending[seq] = e
        out: list[dict] = []
        while self.next_event in self.pending:
            out += self._ordered(self.pending.pop(self.next_event), now)
            self.next_event += 1
        self.gap_since = None if not self.pending else (now if self.gap_since is None else self.gap_since)
        return out + self._drain()

    def _frame(self, seq: int, now: int) -> Frame:
        if seq <= self.finalised:
            raise Fault("late_for_finalised_frame")
        if seq not in self.frames:
            if len(self.frames) >= self.limits.max_open_frames:
                raise Fault("frame_capacity")
            self.frames[seq] = Frame(now)
        return self.frames[seq]

    def _identify(self, seq: int, frame: Frame, identity: list) -> None:
        if frame.identity is None:
            frame.identity = identity
        elif frame.identity != identity:
            raise Fault("frame_identity")
        if self.priors.setdefault(identity[3], seq) != seq:
            raise Fault("prior_reused")
        if len(self.priors) > self.limits.max_priors:
            old = [p for p, s in self.priors.items() if s <= self.finalised]
            for p in sorted(old, key=self.priors.__getitem__)[: len(self.priors) - self.limits.max_priors]:
                del self.priors[p]

    def _ordered(self, e: dict, now: int) -> list[dict]:
        kind, d = e["type"], e["data"]
        if kind == "heartbeat":
            last = d.get("last_fusion_seq")
            if last is not None and last != self.last_summary:
                raise Fault("heartbeat_behind" if last < self.last_summary else "heartbeat_ahead")
            if self.registry_digest is not None:
                queue = d.get("queue_capacity") or 0
                held(self.registries.find(self.registry_digest).document, max_monitor_queue_events=queue, max_active_tracks=d.get("active_track_count") or 0)
            self.heartbeat_at = now
            return [{"kind": "heartbeat", "fusion_seq": last if last is not None else -1, "detail": ""}]
        seq = d["fusion_seq"]
        if seq <= self.last_summary:
            raise Fault("event_after_summary")
        if any(s < seq and f.summary is None and f.events for s, f in self.frames.items()):
            raise Fault("frame_order")
        frame = self._frame(seq, now)
        self._identify(seq, frame, [d["fusion_timestamp_ms"], d["frame_id"], d["context_id"], d["prior_id"]])
        if kind != "frame_summary":
            if len(frame.events) >= self.limits.max_frame_events:
                raise Fault("frame_events")
            frame.events.append({**d, "type": kind})
            return []
        self.last_summary = seq
        if d.get("degraded") or d.get("truncated"):
            raise Fault("degraded_frame")
        if self.registries is not None:
            self._registered(d, frame.events)
        if d["outcome_count"] != len(frame.events):
            raise Fault("outcome_count_mismatch")
        pairs = {(x["track_id"], x["modality"]) for x in frame.events}
        if any(m not in d["expected_modalities"] for _, m in pairs) or any((t, m) not in pairs for t in {t for t, _ in pairs} for m in d["expected_modalities"]):
            raise Fault("invalid_ledger")
        wanted = [x for x in frame.events if x.get("v1_expected")]
        frame.expected = {f"{x['track_id']}/{x['modality']}": x.get("projection") for x in wanted}
        if len(frame.expected) != len(wanted) or len(wanted) != d["v1_expected_count"]:
            raise Fault("v1_expected_count_mismatch")
        frame.summary = d
        for o in frame.observations.values():
            self._joined(frame, o)
        return []

    def _registered(self, summary: dict, events: list[dict]) -> None:
        """A frame against the registry that it names; versions never go back."""
        document = self.registries.find(summary.get("registry_digest")).document
        if document.get("version", 0) < self.registry_version or (
            document.get("version", 0) == self.registry_version and summary["registry_digest"] != self.registry_digest
        ):
            raise Violation("registry_regressed")
        check_summary(document, summary)
        check_events(document, summary, events)
        self.registry_digest, self.registry_version = summary["registry_digest"], document.get("version", 0)

    def _joined(self, frame: Frame, o: dict) -> None:
        key = f"{o['track_id']}/{o['modality']}"
        if key not in frame.expected:
            raise Fault("unexpected_observation")
        if o["timestamp_ms"] != frame.identity[0]:
            raise Fault("observation_timestamp_mismatch")
        if o.get("projection") != frame.expected[key]:
            raise Fault("observation_projection_mismatch")

    def _observation(self, o: dict, now: int) -> list[dict]:
        seq, key = o["seq"], f"{o['track_id']}/{o['modality']}"
        frame = self._frame(seq, now)
        if seq <= self.high_water.get(key, -1):
            raise Fault("observation_not_increasing")
        if key not in self.high_water and len(self.high_water) >= self.limits.max_observation_streams:
            raise Fault("observation_streams")
        self.high_water[key] = seq
        frame.observations[key] = o
        if frame.summary is not None:
            self._joined(frame, o)
        return self._drain()

    def _drain(self) -> list[dict]:
        out = []
        while self.frames:
            seq = min(self.frames)
            f = self.frames[seq]
            if f.summary is None or set(f.expected) - set(f.observations):
                break
            out.append({"kind": "frame", "fusion_seq": seq, "detail": json.dumps({"identity": f.identity, "observations": [f.observations[k] for k in sorted(f.observations)], "events": len(f.events)}, sort_keys=True)})
            self.finalised = seq
            del self.frames[seq]
        return out


def assembled(stream: DataFrame, limits: AssemblerLimits | None = None, registries: Registries | None = None) -> DataFrame:
    """Rows (session_id, producer_id, ordinal, received_ms, route, payload as JSON) to frames, heartbeats and faults.

    A payload that can't be read, is too long or lacks a field ends the stream
    of its key as a fault (``malformed_payload``, ``payload_too_large``,
    ``invalid_envelope``); other keys go on.
    Arrival order matters, so rows of a batch are put in order by ``ordinal``,
    which the source gives; deadlines of rows are judged by ``received_ms``.
    While no row comes, time goes on by the engine's clock from the last one,
    and a timer of the key wakes it at its next deadline.
    With ``registries``, each summary names its registry by digest, and what
    it or its events break of it is a fault whose word begins with
    ``registry_``; a heartbeat is held against the last frame's registry.
    """
    names = ["kind", "fusion_seq", "detail"]

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        saved, received, clock = state.get if state.exists else (None, None, None)
        machine = Assembler(limits, saved, registries)
        wall = state.getCurrentProcessingTimeMs()
        out: list[dict] = []
        if state.hasTimedOut:
            received, clock = received + max(0, wall - clock), wall
            out = machine.advance(received)
        else:
            for r in pd.concat(list(batches)).sort_values("ordinal").to_dict("records"):
                # A row without a time came when the last one did.
                received = (wall if received is None else received) if pd.isna(r["received_ms"]) else int(r["received_ms"])
                out += machine.receive(r["route"], r["payload"], received)
            clock = wall
        state.update((machine.save(), received, clock))
        deadline = machine.next_deadline()
        if deadline is not None:
            state.setTimeoutDuration(max(1, deadline - received))
        if out:
            yield pd.DataFrame(out)[names].assign(session_id=key[0], producer_id=key[1])[["session_id", "producer_id", *names]]

    keyed = stream.groupBy("session_id", "producer_id")
    told = "session_id string, producer_id string, kind string, fusion_seq bigint, detail string"
    kept = "state string, received bigint, clock bigint"
    return keyed.applyInPandasWithState(step, told, kept, "append", GroupStateTimeout.ProcessingTimeTimeout)
