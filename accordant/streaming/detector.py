"""The whole assessment over a stream: admission, magnitude, alignment, correlation and fusion, a frame a verdict, as the batch plan gives.

A frame is assessed when a later one of its track arrives, or when its track
has been quiet, so rows of a frame may come in any order and in several
batches, as long as frames come in order. Admission is ``ordering.Fold``, the
same as in batch: what is incomplete, no number or out of order is refused and
told, and never ends the query.

State a track, typed: a map of channels (last admitted row, CUSUM, the newest
``window_len`` values), the newest aligned frames (``window`` of the
correlation at most), the open frame (a row a channel at most), a map of priors
and a row of numbers. Priors are looked up one by one and not loaded; all else
is bounded. Watermarks aren't used: they would drop late rows, which here are
refused and told.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from accordant.config import CorrelationConfig, DetectorConfig
from accordant.operators.correlation import EPSILON
from accordant.operators.magnitude import critical_values
from accordant.operators.ordering import LARGEST, Channel, Fold
from accordant.schema import canonical

AXES = 3
FIELDS = ("modality", "seq", "timestamp_ms", "dof", "nis", "p0", "p1", "p2", "frame_id", "context_id", "prior_id")
VERDICT = (
    "magnitude_verdict", "magnitude_channels", "consistency", "consistency_status", "fused_verdict", "fused_channels", "fused_magnitude",
)


def pearson(x: np.ndarray, y: np.ndarray) -> float | None:
    """Correlation of two columns, each centred on its mid-range and scaled by half its range; none if degenerate or not finite."""
    if not (np.isfinite(x).all() and np.isfinite(y).all()):
        return None

    def unit(v: np.ndarray) -> np.ndarray | None:
        low, high = v.min(), v.max()
        centre = low / 2 + high / 2
        scale = max(abs(low - centre), abs(high - centre))
        return None if scale == 0 else (v - centre) / scale

    u, v = unit(x), unit(y)
    if u is None or v is None:
        return None
    u, v = u - u.mean(), v - v.mean()
    xx, yy = float(u @ u), float(v @ v)
    if xx <= EPSILON * len(u) or yy <= EPSILON * len(u):
        return None
    return max(-1.0, min(1.0, float(u @ v) / (math.sqrt(xx) * math.sqrt(yy))))


def consensus(r: dict[tuple[int, int], float | None], samples: int, channels: int, cfg: CorrelationConfig, floor: float) -> tuple[str, int]:
    """State of an axis and its decoupled channels as bits; the rules of ``correlation.consensus``."""
    if channels < 3 or samples < cfg.min_samples:
        return "insufficient", 0
    if any(x is None for x in r.values()):
        return "error", 0
    reference = max(r.values())
    threshold = max(cfg.corr_floor, floor, cfg.decouple_ratio * reference)
    edges = {p for p, x in r.items() if x >= threshold}
    members = lambda mask: [i for i in range(channels) if mask >> i & 1]
    cliques = [mask for mask in range(1, 1 << channels) if all(p in edges for p in combinations(members(mask), 2))]
    largest = max(mask.bit_count() for mask in cliques)
    best = [mask for mask in cliques if mask.bit_count() == largest]
    clique = max(best)
    bridged = any((clique >> i & 1) != (clique >> j & 1) for i, j in edges)
    unclear = reference < cfg.corr_floor or floor >= 1.0 or reference < threshold or not (2 * largest > channels and len(best) == 1) or bridged
    if unclear:
        return "insufficient", 0
    everyone = (1 << channels) - 1
    return ("nominal", 0) if clique == everyone else ("decoupled", everyone - clique)


def fused(magnitude: str, own: int, consistency: str, decoupled: int) -> tuple[str, int, str | None]:
    """Verdict, channels as bits and kind of magnitude; the rules of ``fusion.combine``."""
    differs = magnitude in ("attributed", "broad") and own != decoupled
    if consistency == "conflicted" or magnitude == "unclassified":
        verdict = "unclassified"
    elif magnitude == "insufficient" and consistency == "insufficient":
        verdict = "insufficient"
    elif consistency == "decoupled":
        verdict = "unclassified" if differs else "attributed"
    elif magnitude in ("broad", "attributed"):
        verdict = magnitude
    else:
        verdict = "nominal" if magnitude == "nominal" and consistency != "insufficient" else "insufficient"
    both = own | decoupled
    mask = 0
    if verdict in ("unclassified", "attributed"):
        mask = both if consistency in ("decoupled", "conflicted") else own
    kind = None
    if verdict == "attributed":
        if consistency != "decoupled":
            kind = "elevated"
        elif magnitude == "insufficient":
            kind = "insufficient"
        else:
            kind = "in_covariance" if both & own == 0 else "elevated" if both & own == both else "mixed"
    return verdict, mask, kind


class Track:
    """One track, row by row. ``first_use`` gives the first sequence of a prior and remembers the one it is given."""

    def __init__(
        self,
        cfg: DetectorConfig,
        modalities: tuple[str, ...],
        corr: CorrelationConfig | None = None,
        first_use: Callable[[int, int], int] | None = None,
        axes: int = AXES,
    ):
        self.cfg, self.mods, self.axes = cfg, canonical(modalities), axes
        self.corr = (corr or CorrelationConfig()).for_axes(axes)
        self.floors = self.corr.floors(len(self.mods))
        self.first_use = first_use or {}.setdefault
        self.critical: dict[int, list[float]] = {}
        self.fold = Fold(cfg, self.mods, True)
        self.fold.begin(None)
        self.windows: dict[str, list[float]] = {}
        #: Values of the newest usable frames of the suffix: axes times channels a frame.
        self.ring: list[list[float]] = []
        self.open: list[dict] = []
        self.closed_seq: int | None = None
        self.reused_from: int | None = None
        self.begin()

    def begin(self) -> None:
        """A generation begins: no evidence of the one before."""
        self.windows, self.ring = {}, []
        self.row, self.bad, self.before = 0, None, None

    def offer(self, row: dict) -> list[dict]:
        """Take a row of FIELDS: verdicts of frames that it completes, and its refusal."""
        seq, out = row["seq"], []
        key = lambda r: tuple(r[c] for c in ("modality", "seq", "timestamp_ms", "dof", "nis"))
        why = self.fold.refusals([key(row)])[0]
        if why in ("incomplete", "invalid_value"):
            return [self.refused(row, why)]
        used = row["p0"] is not None and row["prior_id"] is not None
        if why != "unexpected_modality":
            if (self.open and seq < self.open[0]["seq"]) or (self.closed_seq is not None and seq <= self.closed_seq):
                return [self.refused(row, "late_frame")]
            if self.open and seq > self.open[0]["seq"]:
                out.append(self.close())
            why = self.fold.refusals([*map(key, self.open), key(row)])[-1]
        if why in (None, "unexpected_modality") and used and self.first_use(row["prior_id"], seq) != seq:
            self.reused_from = seq if self.reused_from is None else min(self.reused_from, seq)
        if why:
            return [*out, self.refused(row, why)]
        self.open.append(row)
        return out

    def refused(self, row: dict, why: str) -> dict:
        nothing = dict.fromkeys(VERDICT)
        return {"generation": self.fold.generation, "seq": row["seq"], "modality": row["modality"], "reason": why} | nothing

    def close(self) -> dict:
        """Assess the open frame."""
        rows, self.open = self.open, []
        seq = self.closed_seq = rows[0]["seq"]
        told = self.fold.frame(None, [tuple(r[c] for c in ("modality", "seq", "timestamp_ms", "dof", "nis")) for r in rows])
        if told[0][5]:
            self.begin()
        by = {r["modality"]: r for r in rows}
        for m, r in by.items():
            self.windows[m] = [*self.windows.get(m, []), r["nis"]][-self.cfg.window_len :]
        self.row += 1
        magnitude, own = self._magnitude(by)
        status, consistency, decoupled = self._consistency(by, seq)
        verdict, mask, kind = fused(magnitude, own, consistency, decoupled)
        values = (magnitude, self._names(own), consistency, status, verdict, self._names(mask), kind)
        return {"generation": self.fold.generation, "seq": seq, "modality": None, "reason": None} | dict(zip(VERDICT, values, strict=True))

    def _names(self, mask: int) -> str:
        return ",".join(m for i, m in enumerate(self.mods) if mask >> i & 1)

    def _magnitude(self, by: dict[str, dict]) -> tuple[str, int]:
        cfg, ready, own, high, low, stamps = self.cfg, 0, 0, 0, False, []
        for i, m in enumerate(self.mods):
            window = self.windows.get(m, [])
            if m not in by or len(window) < cfg.min_samples:
                continue
            channel, dof = self.fold.channels[m], by[m]["dof"]
            limits = self.critical.setdefault(dof, critical_values(cfg, len(self.mods), dof))
            total = min(LARGEST, math.fsum(x / 65536 for x in window) * 65536)
            up = total > limits[len(window)] or channel.hi >= cfg.cusum_threshold
            down = channel.lo >= cfg.cusum_threshold
            ready, high, low = ready + 1, high + up, low | down
            stamps.append(by[m]["timestamp_ms"])
            own |= (up or down) << i
        span = max(stamps) - min(stamps) if stamps else 0
        complete = ready >= cfg.min_channels and ready == len(self.mods) and span <= cfg.max_timestamp_skew_ms
        if own and (not complete or low):
            return "unclassified", own
        if not complete:
            return "insufficient", own
        if not high:
            return "nominal", own
        return ("broad" if high >= 2 and high >= cfg.jam_fraction * ready else "attributed"), own

    def _aligned(self, by: dict[str, dict], seq: int) -> tuple[bool, bool]:
        """Whether the frame is usable, and whether its projections are broken; keeps the suffix."""
        cfg, first = self.cfg, by.get(self.mods[0])
        complete = all(m in by for m in self.mods)
        n = sum(by[m]["p0"] is not None for m in self.mods) if complete else 0
        one = lambda c: first[c] is not None and all(by[m][c] == first[c] for m in self.mods)
        agree = complete and all(map(one, ("frame_id", "context_id", "prior_id")))
        partial = complete and n > 0 and (n < len(self.mods) or not agree)
        stamps = {m: r["timestamp_ms"] for m, r in by.items()}
        usable = complete and n == len(self.mods) and not partial and max(stamps.values()) - min(stamps.values()) <= cfg.max_timestamp_skew_ms
        b = self.before
        follows = (
            usable and b is not None and b["usable"] and seq - b["seq"] <= cfg.max_seq_gap
            and (first["frame_id"], first["context_id"]) == (b["frame_id"], b["context_id"])
            and all(stamps[m] - b["stamps"][m] <= cfg.max_inter_sample_gap_ms for m in self.mods)
        )
        if not follows:
            self.ring = []
        if usable:
            frame = [by[m][f"p{a}"] for a in range(self.axes) for m in self.mods]
            self.ring = [*self.ring, frame][-self.corr.window :]
        ids = {c: first[c] if first else None for c in ("frame_id", "context_id")}
        self.before = {"usable": usable, "seq": seq, "stamps": stamps} | ids
        return usable, partial

    def _consistency(self, by: dict[str, dict], seq: int) -> tuple[str, str, int]:
        usable, partial = self._aligned(by, seq)
        if partial:
            self.bad = self.row
        spoilt = self.bad is not None and self.row - self.bad < self.corr.window
        if len(self.mods) < self.cfg.min_channels:
            return "too_few_modalities", "insufficient", 0
        if spoilt or (self.reused_from is not None and seq >= self.reused_from):
            return "extraction_error", "insufficient", 0
        if not usable:
            return "missing_projection", "insufficient", 0
        c, w = len(self.mods), len(self.ring)
        enough = w >= self.corr.min_samples and c >= 3
        values = np.array(self.ring, float) if enough else None
        states = []
        for a in range(self.axes):
            r = {(i, j): pearson(values[:, a * c + i], values[:, a * c + j]) for i, j in combinations(range(c), 2)} if enough else {}
            states.append(consensus(r, w, c, self.corr, self.floors[w]))
        union = 0
        for _, mask in states:
            union |= mask
        if any(s == "error" for s, _ in states):
            return "analysis_error", "insufficient", 0
        missing = any(s == "insufficient" for s, _ in states)
        status = "assessed_insufficient" if missing else "assessed"
        differs = any(s == "decoupled" and mask != union for s, mask in states)
        if union and (differs or missing):
            return status, "conflicted", union
        if missing:
            return status, "insufficient", 0
        return (status, "decoupled", union) if union else (status, "intact", 0)


CHANNEL_STATE = "seq bigint, timestamp_ms bigint, dof int, hi double, lo double, window array<double>"
FRAME_STATE = "values array<double>"
ROW_STATE = "modality string, seq bigint, timestamp_ms bigint, dof int, nis double, p0 double, p1 double, p2 double, frame_id bigint, context_id bigint, prior_id bigint"
TRACK_STATE = (
    "generation bigint, closed_seq bigint, reused_from bigint, row bigint, bad bigint, usable boolean, before_seq bigint, "
    "frame_id bigint, context_id bigint, stamped array<string>, stamps array<bigint>"
)
OUTPUT = "track_id bigint, generation bigint, seq bigint, modality string, reason string, " + ", ".join(f"{c} string" for c in VERDICT)
NAMES = ("generation", "seq", "modality", "reason", *VERDICT)


class TrackProcessor(StatefulProcessor):
    """A track's typed state around ``Track``."""

    def __init__(self, modalities: tuple[str, ...], detector: DetectorConfig, corr: CorrelationConfig, quiet_ms: int | None):
        self.modalities, self.detector, self.corr, self.quiet_ms = modalities, detector, corr, quiet_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.numbers = handle.getValueState("track", TRACK_STATE)
        self.channels = handle.getMapState("channels", "modality string", CHANNEL_STATE)
        self.frames = handle.getListState("frames", FRAME_STATE)
        self.rows = handle.getListState("open", ROW_STATE)
        self.priors = handle.getMapState("priors", "prior_id bigint", "seq bigint")

    def _first_use(self, prior: int, seq: int) -> int:
        if self.priors.containsKey((prior,)):
            return self.priors.getValue((prior,))[0]
        self.priors.updateValue((prior,), (seq,))
        return seq

    def _load(self) -> Track:
        t = Track(self.detector, self.modalities, self.corr, self._first_use)
        if not self.numbers.exists():
            return t
        told = self.numbers.get()
        t.fold.generation, t.closed_seq, t.reused_from, t.row, t.bad, usable, before, frame_id, context_id, stamped, stamps = told
        if before is not None:
            at = dict(zip(stamped, stamps, strict=True))
            t.before = {"usable": usable, "seq": before, "stamps": at, "frame_id": frame_id, "context_id": context_id}
        for (modality,), (seq, timestamp_ms, dof, hi, lo, window) in self.channels.iterator():
            channel = t.fold.channels[modality] = Channel(seq, timestamp_ms, dof)
            channel.hi, channel.lo = hi, lo
            t.windows[modality] = list(window)
        t.ring = [list(values) for (values,) in self.frames.get()]
        t.open = [dict(zip(FIELDS, row, strict=True)) for row in self.rows.get()]
        return t

    def _save(self, t: Track) -> None:
        b = t.before or {"usable": None, "seq": None, "stamps": {}, "frame_id": None, "context_id": None}
        last = (b["usable"], b["seq"], b["frame_id"], b["context_id"], list(b["stamps"]), list(b["stamps"].values()))
        self.numbers.update((t.fold.generation, t.closed_seq, t.reused_from, t.row, t.bad, *last))
        self.channels.clear()
        for m, c in t.fold.channels.items():
            self.channels.updateValue((m,), (c.seq, c.timestamp_ms, c.dof, c.hi, c.lo, t.windows.get(m, [])))
        for state, values in ((self.frames, [(v,) for v in t.ring]), (self.rows, [tuple(r[c] for c in FIELDS) for r in t.open])):
            state.clear()
            if values:
                state.put(values)

    def _told(self, key: tuple, out: list[dict]) -> Iterator[pd.DataFrame]:
        if out:
            frame = pd.DataFrame({c: pd.array([o[c] for o in out], "Int64") if c in ("generation", "seq") else [o[c] for o in out] for c in NAMES})
            frame.insert(0, "track_id", pd.array([None if pd.isna(key[0]) else int(key[0])] * len(out), "Int64"))
            yield frame

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        track, out = self._load(), []
        given = pd.concat(list(rows)).sort_values(["seq", "timestamp_ms", "modality", "dof", "nis"])
        columns = [given[c].tolist() for c in (*FIELDS, "missing")]
        for *values, missing in zip(*columns, strict=True):
            row = {c: None if missing >> i & 1 else v for i, (c, v) in enumerate(zip(FIELDS, values, strict=True))}
            out += track.offer(row)
        self._save(track)
        if self.quiet_ms is not None:
            for at in [t[0] for t in self.handle.listTimers()]:
                self.handle.deleteTimer(at)
            if track.open:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.quiet_ms)
        yield from self._told(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        track = self._load()
        out = [track.close()] if track.open else []
        self._save(track)
        yield from self._told(key, out)

    def close(self) -> None:
        pass


def verdicts(
    stream: DataFrame,
    modalities: tuple[str, ...],
    detector: DetectorConfig | None = None,
    corr: CorrelationConfig | None = None,
    quiet_ms: int | None = None,
) -> DataFrame:
    """A stream of observations (track_id and FIELDS) to a stream of verdicts and refusals (with a ``reason``), in append mode.

    Rows of a batch are put in order within their track; a track's last frame
    is told when the next one arrives or, with ``quiet_ms``, once no row has
    come for so long, by a timer. Rows of a frame that was told are refused.
    The session must keep state in RocksDB
    (``spark.sql.streaming.stateStore.providerClass``), as typed state needs it.
    """
    provider = stream.sparkSession.conf.get("spark.sql.streaming.stateStore.providerClass", "")
    if "RocksDB" not in provider:
        raise ValueError("set spark.sql.streaming.stateStore.providerClass to RocksDBStateStoreProvider of the engine")
    empty = {"string": F.lit(""), "bigint": F.lit(0).cast("long"), "int": F.lit(0), "double": F.lit(0.0)}
    kinds = dict(x.rsplit(" ", 1) for x in ROW_STATE.split(", "))
    missing = sum((F.when(F.col(c).isNull(), 1 << i).otherwise(0) for i, c in enumerate(FIELDS)), F.lit(0))
    # Nulls travel as bits beside the values, so that no whole number becomes a double on its way.
    full = [F.coalesce(F.col(c).cast(kinds[c]), empty[kinds[c]]).alias(c) for c in FIELDS]
    processor = TrackProcessor(modalities, detector or DetectorConfig(), corr or CorrelationConfig(), quiet_ms)
    keyed = stream.select("track_id", *full, missing.alias("missing")).groupBy("track_id")
    return keyed.transformWithStateInPandas(processor, OUTPUT, "append", "processingTime" if quiet_ms is not None else "none")
