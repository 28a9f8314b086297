"""Lifecycle of a producer's stream: data and control rows in one keyed stream, assessments of bounded history, a hash-linked log of receipts.

A lane is one (producer, session, stream). A position is epoch, state
generation, sequence, timestamp and clock. Frames follow one another without a
gap; what breaks continuity (another projection frame, context, registry or
set of modalities, or a long silence) needs the next generation, and a new
epoch begins at zero. Control rows ``reset`` and ``timeout`` take the next
sequence and generation, ``rollover`` a new epoch. Each decision is a receipt
whose digest covers the receipt before it. A row that breaks a rule is told by
a receipt and closes its lane, which from then on admits nothing; other lanes
go on.

State a lane, typed: its last position and link, the digests of the newest
``recent_frames`` frames, epochs (``max_epochs`` at most) and, for each track
that the last frame froze, its newest frames (``history_frames``). The log is a
file sink in append mode, so a batch that runs again is published once.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator, MutableMapping
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from accordant.config import CorrelationConfig, DetectorConfig
from accordant.schema import MODALITIES, canonical
from accordant.streaming.detector import FIELDS as OBSERVED
from accordant.streaming.detector import VERDICT, Track

GENESIS = "0" * 64
LANE = ("producer_id", "session_id", "stream_id")
#: Fields under a receipt's digest, in this order.
FIELDS = ("index", "previous_digest", "producer_id", "position", "transition", "frame_digest", "assessment_digest")
RECEIPTS = (
    "producer_id string, session_id string, stream_id string, index bigint, previous_digest string, position string, "
    "transition string, frame_digest string, assessment_digest string, assessments string, digest string"
)
_TOLD = tuple(c.split()[0] for c in RECEIPTS.split(", "))
POSITION = ("epoch_id", "generation", "seq", "timestamp_ms", "clock")
CONTINUITY = ("frame_id", "context_id", "registry_digest", "modalities")
#: Why continuity is broken, by the field that differs.
BREAKS = dict(zip(CONTINUITY, ("projection_frame", "projection_context", "projection_registry", "expected_modalities"), strict=True))
FRAME = (
    "kind string, epoch_id string, generation bigint, seq bigint, timestamp_ms bigint, clock string, frame_id bigint, "
    "context_id bigint, prior_id bigint, registry_digest string, modalities array<string>, frozen array<bigint>, "
    "observations array<struct<track_id bigint, modality string, seq bigint, timestamp_ms bigint, dof int, nis double, "
    "p0 double, p1 double, p2 double, frame_id bigint, context_id bigint, prior_id bigint>>"
)


def canonical_json(value: object) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def digest_of(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


@dataclass(frozen=True)
class LifecycleLimits:
    history_frames: int = 128
    recent_frames: int = 4_096
    max_epochs: int = 1_024
    max_gap_ms: int = 10_000

    def __post_init__(self) -> None:
        if min(self.history_frames, self.recent_frames, self.max_epochs, self.max_gap_ms) < 1:
            raise ValueError("limits are at least 1")


class Refused(Exception):
    """A row that breaks a rule of admission."""


class Faulted(Exception):
    """A frame that isn't sound in itself, or can't be assessed."""


class _Recent(Track):
    """A track whose verdict is wanted for its newest frame only."""

    judging = False

    def _magnitude(self, by: dict[str, dict]) -> tuple[str, int]:
        return super()._magnitude(by) if self.judging else ("insufficient", 0)

    def _consistency(self, by: dict[str, dict], seq: int) -> tuple[str, str, int]:
        if self.judging:
            return super()._consistency(by, seq)
        if self._aligned(by, seq)[1]:
            self.bad = self.row
        return "assessed", "insufficient", 0


def assessed(history: list[list[dict]], modalities: tuple[str, ...], detector: DetectorConfig, corr: CorrelationConfig) -> dict:
    """The verdict of the newest frame of a history, from nothing but that history."""
    track = _Recent(detector, modalities, corr)
    for frame in history:
        for row in frame:
            for told in track.offer({c: row.get(c) for c in OBSERVED}):
                if told["reason"]:
                    raise Faulted(f"assessment:{told['reason']}")
    track.judging = True
    told = track.close()
    return {c: told[c] for c in VERDICT}


def ledger_fault(frame: dict) -> str | None:
    """The first observation that the frozen ledger doesn't allow: why."""
    frozen, seen = set(frame["frozen"]), set()
    for o in frame["observations"]:
        # Text stands for what is no finite number.
        if any(isinstance(o.get(c), str) for c in ("nis", "p0", "p1", "p2")) or "nis" not in o or "dof" not in o:
            return "invalid_value"
        pair = (o.get("track_id"), o.get("modality"))
        if pair[0] not in frozen:
            return "track_not_frozen"
        if pair[1] not in frame["modalities"]:
            return "unexpected_modality"
        if pair in seen:
            return "repeated_observation"
        seen.add(pair)
        if (o.get("seq"), o.get("timestamp_ms")) != (frame["seq"], frame["timestamp_ms"]):
            return "observation_position"
        if "p0" in o and any(o.get(c) != frame.get(c) for c in ("frame_id", "context_id", "prior_id")):
            return "projection_provenance"
    return None


@dataclass
class Lane:
    """The rules, call by call; ``recent``, ``epochs`` and ``tracks`` may be views of a store."""

    key: tuple
    detector: DetectorConfig = field(default_factory=DetectorConfig)
    corr: CorrelationConfig = field(default_factory=CorrelationConfig)
    limits: LifecycleLimits = field(default_factory=LifecycleLimits)
    recent: MutableMapping = field(default_factory=dict)
    epochs: MutableMapping = field(default_factory=dict)
    tracks: dict = field(default_factory=dict)
    last: dict | None = None
    continuity: dict | None = None
    index: int = 0
    previous: str = GENESIS
    fault: str | None = None

    def _receipt(self, row: dict, transition: dict, frame_digest: str | None, assessments: str | None = None) -> dict:
        place = dict(zip(LANE, self.key, strict=True))
        body = place | {
            "index": self.index, "previous_digest": self.previous,
            "position": canonical_json({c: row.get(c) for c in POSITION} | {c: place[c] for c in LANE[1:]}),
            "transition": canonical_json(transition), "frame_digest": frame_digest,
            "assessment_digest": None if assessments is None else digest_of(assessments), "assessments": assessments,
        }
        body["digest"] = digest_of("\x1f".join("" if body[f] is None else str(body[f]) for f in FIELDS))
        self.index, self.previous = self.index + 1, body["digest"]
        return body

    def offer(self, row: dict, frame_digest: str | None = None) -> dict | None:
        """Take a row (columns of FRAME, those that are null left out): its receipt, none once the lane is closed."""
        if self.fault:
            return None
        control = row.get("kind") != "frame"
        try:
            if any(c not in row for c in POSITION) or None in self.key or min(row["generation"], row["seq"], row["timestamp_ms"]) < 0:
                raise Faulted("invalid_position")
            return self._control(row) if control else self._frame(row, frame_digest)
        except (Refused, Faulted) as why:
            self.fault, self.tracks = str(why), {}
            kind = "rejected" if isinstance(why, Refused) else "faulted"
            return self._receipt(row, {"kind": kind, "reason": str(why)}, None if control else frame_digest)

    def _moved(self, row: dict) -> None:
        self.last = {c: row[c] for c in POSITION}

    def _rolled(self, row: dict) -> dict:
        """A new epoch begins."""
        if self.last is None:
            raise Refused("unknown_stream")
        if row["epoch_id"] == self.last["epoch_id"] or row["epoch_id"] in self.epochs:
            raise Refused("reused_epoch")
        if len(self.epochs) >= self.limits.max_epochs:
            raise Refused("epoch_capacity")
        if row["seq"] or row["generation"]:
            raise Refused("invalid_rollover_origin")
        if row["clock"] != self.last["clock"]:
            raise Refused("clock_domain_changed")
        before = self.last["epoch_id"]
        self.epochs[row["epoch_id"]] = True
        self.recent.clear()
        self.tracks, self.continuity = {}, None
        return {"kind": "rollover", "previous_epoch_id": before}

    def _control(self, row: dict) -> dict:
        kind = row.get("kind")
        if kind == "rollover":
            transition = self._rolled(row)
        elif kind in ("reset", "timeout"):
            q = self.last
            same = q is not None and (row["epoch_id"], row["clock"]) == (q["epoch_id"], q["clock"])
            if not same or (row["seq"], row["generation"]) != (q["seq"] + 1, q["generation"] + 1) or row["timestamp_ms"] <= q["timestamp_ms"]:
                raise Refused("invalid_reset_successor")
            transition = {"kind": "reset", "reasons": ["explicit" if kind == "reset" else "timeout"]}
            self.tracks, self.continuity = {}, None
        else:
            raise Faulted("unknown_kind")
        self._moved(row)
        return self._receipt(row, transition, None)

    def _sound(self, row: dict) -> dict:
        """The frame with empty lists for those left out; its own rules."""
        frame = {"modalities": [], "frozen": [], "observations": []} | row
        mods = frame["modalities"]
        if not mods or any(m not in MODALITIES for m in mods) or list(canonical(tuple(mods))) != mods or len(set(mods)) != len(mods):
            raise Faulted("modalities_not_canonical")
        if len(mods) < self.detector.min_channels:
            raise Faulted("too_few_modalities")
        if len(set(frame["frozen"])) > self.detector.max_tracks:
            raise Faulted("track_capacity")
        why = ledger_fault(frame)
        if why:
            raise Faulted(why)
        return frame

    def _breaks(self, row: dict) -> list[str]:
        if self.continuity is None:
            return []
        out = [why for c, why in BREAKS.items() if self.continuity.get(c) != row.get(c)]
        return out + ["inter_sample_deadline"] * (row["timestamp_ms"] - self.last["timestamp_ms"] > self.limits.max_gap_ms)

    def _admitted(self, row: dict, frame_digest: str) -> dict:
        q = self.last
        if q is None:
            if row["generation"]:
                raise Refused("state_generation_mismatch")
            self.epochs[row["epoch_id"]] = True
            return {"kind": "initialize"}
        if row["epoch_id"] != q["epoch_id"]:
            return self._rolled(row)
        if row["clock"] != q["clock"]:
            raise Refused("clock_domain_changed")
        if row["seq"] <= q["seq"]:
            known = self.recent.get(row["seq"])
            if known is None:
                raise Refused("reordered")
            if known != frame_digest:
                raise Refused("conflicting_replay")
            raise Refused("duplicate" if row["seq"] == q["seq"] else "replay")
        if row["seq"] != q["seq"] + 1:
            raise Refused("forward_sequence_gap")
        if row["timestamp_ms"] <= q["timestamp_ms"]:
            raise Refused("non_increasing_timestamp")
        breaks, ahead = self._breaks(row), row["generation"] - q["generation"]
        if not breaks and not ahead:
            return {"kind": "advance"}
        if breaks and not ahead:
            raise Refused("missing_reset:" + ",".join(breaks))
        if ahead != 1:
            raise Refused("state_generation_mismatch")
        self.tracks = {}
        return {"kind": "reset", "reasons": breaks or ["explicit"]}

    def _frame(self, row: dict, frame_digest: str) -> dict:
        frame = self._sound(row)
        transition = self._admitted(frame, frame_digest)
        told = canonical_json(self._assessed(frame, transition["kind"] != "advance"))
        self._moved(row)
        self.continuity = {c: frame.get(c) for c in CONTINUITY}
        self.recent[row["seq"]] = frame_digest
        self.recent.pop(row["seq"] - self.limits.recent_frames, None)
        return self._receipt(row, transition, frame_digest, told)

    def _assessed(self, frame: dict, reset: bool) -> list[dict]:
        """One entry a frozen track, in their order: abstained, or the verdict of its history."""
        mods, by, out = tuple(frame["modalities"]), {}, []
        for o in frame["observations"]:
            by.setdefault(o["track_id"], {})[o["modality"]] = o
        frozen = sorted(set(frame["frozen"]))
        self.tracks = {t: self.tracks[t] for t in frozen if t in self.tracks}
        for t in frozen:
            given = by.get(t, {})
            absent = [m for m in mods if "p0" not in given.get(m, {})]
            if absent:
                self.tracks.pop(t, None)
                out.append({"track_id": t, "seq": frame["seq"], "abstained": absent})
                continue
            fresh = reset or t not in self.tracks
            history = [*self.tracks.get(t, []), [given[m] for m in mods]][-self.limits.history_frames :]
            self.tracks[t] = history
            told = assessed(history, mods, self.detector, self.corr)
            out.append({"track_id": t, "seq": frame["seq"], "history_reset": fresh} | told)
        return out


_LANE_STATE = (
    "epoch_id string, generation bigint, seq bigint, timestamp_ms bigint, clock string, index bigint, previous string, "
    "fault string, continuity string"
)


class _Stored(MutableMapping):
    """A map state of one value a key, as a mapping that isn't loaded."""

    def __init__(self, state) -> None:  # noqa: ANN001
        self.state = state

    def __getitem__(self, key: object) -> object:
        if not self.state.containsKey((key,)):
            raise KeyError(key)
        return self.state.getValue((key,))[0]

    def __setitem__(self, key: object, value: object) -> None:
        self.state.updateValue((key,), (value,))

    def __delitem__(self, key: object) -> None:
        self.state.removeKey((key,))

    def __iter__(self) -> Iterator:
        return iter([k for (k,) in self.state.keys()])

    def __len__(self) -> int:
        return sum(1 for _ in self.state.keys())

    def __contains__(self, key: object) -> bool:
        return self.state.containsKey((key,))

    def clear(self) -> None:
        self.state.clear()


class LaneProcessor(StatefulProcessor):
    """A lane's typed state around ``Lane``."""

    def __init__(self, detector: DetectorConfig, corr: CorrelationConfig, limits: LifecycleLimits):
        self.detector, self.corr, self.limits = detector, corr, limits

    def init(self, handle) -> None:  # noqa: ANN001
        self.lane = handle.getValueState("lane", _LANE_STATE)
        self.recent = handle.getMapState("recent", "seq bigint", "digest string")
        self.epochs = handle.getMapState("epochs", "epoch_id string", "used boolean")
        self.tracks = handle.getMapState("tracks", "track_id bigint", "frames array<string>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        place = tuple(None if pd.isna(k) else k for k in key)
        lane = Lane(place, self.detector, self.corr, self.limits, _Stored(self.recent), _Stored(self.epochs))
        if self.lane.exists():
            *position, lane.index, lane.previous, lane.fault, continuity = self.lane.get()
            lane.last = None if position[0] is None else dict(zip(POSITION, position, strict=True))
            lane.continuity = json.loads(continuity) if continuity else None
        if lane.fault:
            return
        lane.tracks = {t: [json.loads(f) for f in frames] for (t,), (frames,) in self.tracks.iterator()}
        before = set(lane.tracks)
        given = pd.concat(list(rows)).sort_values(["arrival", "row"], na_position="last")
        told = [lane.offer(json.loads(row), digest) for row, digest in zip(given["row"], given["frame_digest"], strict=True)]
        for t in before - set(lane.tracks):
            self.tracks.removeKey((t,))
        for t, frames in lane.tracks.items():
            self.tracks.updateValue((t,), ([canonical_json(f) for f in frames],))
        position = [lane.last[c] for c in POSITION] if lane.last else [None] * len(POSITION)
        self.lane.update((*position, lane.index, lane.previous, lane.fault, canonical_json(lane.continuity) if lane.continuity else None))
        out = [r for r in told if r]
        if out:
            yield pd.DataFrame(out)[list(_TOLD)]

    def close(self) -> None:
        pass


def receipts(
    stream: DataFrame,
    detector: DetectorConfig | None = None,
    corr: CorrelationConfig | None = None,
    limits: LifecycleLimits | None = None,
) -> DataFrame:
    """A stream of LANE, ``arrival`` and the columns of FRAME to a stream of RECEIPTS, in append mode.

    ``kind`` is frame, reset, timeout or rollover. Rows of a batch are taken in
    the order of ``arrival``, then of content. A frame's digest is of its JSON,
    observations in the order of track and modality. Needs the RocksDB state
    store, as typed state does.
    """
    names = [n for n in T.StructType.fromDDL(FRAME).names if n in stream.columns]
    whole = F.struct(*(F.array_sort(n).alias(n) if n in ("observations", "frozen") else F.col(n) for n in names))
    rows = stream.select(*LANE, F.col("arrival").cast("double").alias("arrival"), F.to_json(whole).alias("row"))
    keyed = rows.withColumn("frame_digest", F.sha2("row", 256)).groupBy(*LANE)
    processor = LaneProcessor(detector or DetectorConfig(), corr or CorrelationConfig(), limits or LifecycleLimits())
    return keyed.transformWithStateInPandas(processor, RECEIPTS, "append", "none")


def published(told: DataFrame, log: str, checkpoint: str, **trigger: object) -> StreamingQuery:
    """Append receipts to a log. The sink's own record of batches publishes each once, also after a restart in the midst of one."""
    writer = told.writeStream.format("parquet").outputMode("append").option("path", log).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()


def verified(told: DataFrame) -> DataFrame:
    """Add ``fault`` (null if sound) to a log of receipts: digests, first link, index, link, and nothing after a lane was closed.

    Digests are recomputed from the row, links by the row before; one exchange
    on the lane.
    """
    w = Window.partitionBy(*LANE).orderBy("index")
    own = F.sha2(F.concat_ws("\x1f", *(F.coalesce(F.col(f).cast("string"), F.lit("")) for f in FIELDS)), 256)
    before, last = F.lag("digest").over(w), F.lag("index").over(w)
    closed = F.get_json_object(F.lag("transition").over(w), "$.kind").isin("rejected", "faulted")
    moved = [~F.col(c).eqNullSafe(F.get_json_object("position", f"$.{c}")) for c in LANE[1:]]
    fault = (
        F.when(F.col("digest") != own, "digest")
        .when(~F.sha2("assessments", 256).eqNullSafe(F.col("assessment_digest")), "assessments")
        .when(moved[0] | moved[1], "place")
        .when(F.col("index") != F.coalesce(last + 1, F.lit(0)), "index")
        .when(before.isNull() & (F.col("previous_digest") != GENESIS), "first_link")
        .when(before != F.col("previous_digest"), "link")
        .when(closed, "after_close")
    )
    return told.withColumn("fault", fault)
