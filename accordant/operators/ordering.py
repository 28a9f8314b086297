"""Order checks, generations and CUSUM: what depends on the last admitted row of a channel, in one pass over sorted rows.

Whether a row is sound depends on the rows admitted before it, and a reset on
both, so no window over rows says it. Rows are dealt by track and sorted, and
each task folds its rows as they stream by: the state is a few numbers a
channel of the current track, however long that is. Held back are only the sound
rows of the frame at the end of an Arrow batch.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from accordant.config import DetectorConfig

ADDED = T.StructType(
    [
        T.StructField("prev_seq", T.LongType()),
        T.StructField("prev_timestamp_ms", T.LongType()),
        T.StructField("reject", T.StringType()),
        T.StructField("discontinuous", T.BooleanType()),
        T.StructField("generation", T.LongType()),
        T.StructField("is_reset", T.BooleanType()),
        T.StructField("cusum_hi", T.DoubleType()),
        T.StructField("cusum_lo", T.DoubleType()),
    ]
)
READ = ("track_id", "modality", "seq", "timestamp_ms", "dof", "nis")
LARGEST = math.ldexp(2.0 - 2.0**-52, 1023)


class Channel:
    """The last admitted row of a channel and its two sums."""

    __slots__ = ("dof", "hi", "lo", "seq", "timestamp_ms")

    def __init__(self, seq: int, timestamp_ms: int, dof: int):
        self.seq, self.timestamp_ms, self.dof = seq, timestamp_ms, dof
        self.hi = self.lo = 0.0

    def refusal(self, seq: int, timestamp_ms: int, dof: int) -> str | None:
        if seq <= self.seq:
            return "sequence_not_increasing"
        if dof != self.dof:
            return "dof_changed"
        return "timestamp_not_increasing" if timestamp_ms <= self.timestamp_ms else None

    def late(self, seq: int, timestamp_ms: int, cfg: DetectorConfig) -> bool:
        return seq - self.seq > cfg.max_seq_gap or timestamp_ms - self.timestamp_ms > cfg.max_inter_sample_gap_ms

    def push(self, seq: int, timestamp_ms: int, nis: float, slack: float) -> None:
        scale = math.sqrt(2.0 * self.dof)
        shift = nis / scale - self.dof / scale
        self.hi = min(LARGEST, max(0.0, self.hi + shift - slack))
        self.lo = min(LARGEST, max(0.0, self.lo - shift - slack))
        self.seq, self.timestamp_ms = seq, timestamp_ms


class Fold:
    """State of the current track; ``resets`` says whether a discontinuity begins a generation for all its channels."""

    def __init__(self, cfg: DetectorConfig, modalities: tuple[str, ...] | None, resets: bool):
        self.cfg, self.modalities, self.resets = cfg, modalities, resets
        self.track: object = self
        self.channels: dict[str, Channel] = {}
        self.generation = 0

    def begin(self, track: object) -> None:
        """Forget the track before, if it is another."""
        if track != self.track:
            self.track, self.channels, self.generation = track, {}, 0

    def refusals(self, rows: list[tuple]) -> list[str | None]:
        """Why each row (modality, seq, timestamp_ms, dof, nis) of one frame is no evidence; null for sound ones."""
        out, here = [], set()
        for modality, seq, timestamp_ms, dof, nis in rows:
            before = self.channels.get(modality)
            if modality is None or seq is None or timestamp_ms is None or dof is None or nis is None:
                why = "incomplete"
            elif not (math.isfinite(nis) and nis >= 0 and dof > 0):
                why = "invalid_value"
            elif self.modalities is not None and modality not in self.modalities:
                why = "unexpected_modality"
            elif modality in here:
                why = "sequence_not_increasing"
            else:
                why = before.refusal(seq, timestamp_ms, dof) if before else None
            if not why:
                here.add(modality)
            out.append(why)
        return out

    def last(self, modality: str | None) -> tuple[int | None, int | None]:
        before = self.channels.get(modality)
        return (before.seq, before.timestamp_ms) if before else (None, None)

    def refused(self, row: tuple, why: str) -> tuple:
        """ADDED of a row that changes nothing."""
        return (*self.last(row[0]), why, False, self.generation, False, None, None)

    def frame(self, track: object, rows: list[tuple]) -> list[tuple]:
        """ADDED of each row (modality, seq, timestamp_ms, dof, nis) of one frame."""
        self.begin(track)
        cfg, channels = self.cfg, self.channels
        why = self.refusals(rows)
        out = [self.refused(row, w) if w else None for row, w in zip(rows, why, strict=True)]
        sound = []
        for i, (modality, seq, timestamp_ms, _, _) in enumerate(rows):
            if not why[i]:
                before = channels.get(modality)
                sound.append((i, self.last(modality), before is not None and before.late(seq, timestamp_ms, cfg)))
        reset = self.resets and any(late for *_, late in sound)
        if reset:
            channels.clear()
            self.generation += 1
        for i, last, late in sound:
            modality, seq, timestamp_ms, dof, nis = rows[i]
            channel = channels.get(modality)
            if channel is None:
                channel = channels[modality] = Channel(seq, timestamp_ms, dof)
            channel.push(seq, timestamp_ms, nis, cfg.cusum_slack)
            out[i] = (*last, None, late, self.generation, reset, channel.hi, channel.lo)
        return out


def _folded(batches: Iterator[pa.RecordBatch], state: Fold, added: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Fold sorted rows; of the frame at a batch's end only sound rows are held back, so one a channel at most."""
    held: pa.Table | None = None

    def told(rows: pa.Table, new: list[tuple]) -> Iterator[pa.RecordBatch]:
        table = rows
        for f, c in zip(added, zip(*new, strict=True), strict=True):
            table = table.append_column(f, pa.array(c, f.type))
        yield from table.combine_chunks().to_batches()

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        rows = rows if held is None else pa.concat_tables([held, rows]).combine_chunks()
        tracks, *columns = [rows.column(c).to_pylist() for c in READ]
        seqs = columns[1]
        values, out, at = list(zip(*columns, strict=True)), [], 0
        while at < len(tracks):
            end = at + 1
            # A row without a sequence is no part of a frame.
            while end < len(tracks) and seqs[at] is not None and seqs[end] == seqs[at] and tracks[end] == tracks[at]:
                end += 1
            if end == len(tracks) and seqs[at] is not None:
                break
            out += state.frame(tracks[at], values[at:end])
            at = end
        if out:
            yield from told(rows.slice(0, at), out)
        held = None
        if at < len(tracks):
            state.begin(tracks[at])
            why = state.refusals(values[at:])
            bad = [i for i, w in enumerate(why) if w]
            if bad:
                yield from told(rows.take(pa.array([at + i for i in bad], pa.int64())), [state.refused(values[at + i], why[i]) for i in bad])
            held = rows.take(pa.array([at + i for i, w in enumerate(why) if not w], pa.int64()))
            held = held if held.num_rows else None
    if held is not None:
        columns = [held.column(c).to_pylist() for c in READ]
        yield from told(held, state.frame(columns[0][0], list(zip(*columns[1:], strict=True))))


def checked(rows: DataFrame, cfg: DetectorConfig, modalities: tuple[str, ...] | None = None, resets: bool = True) -> DataFrame:
    """Add to rows (of ``READ`` and any others) the columns of ``ADDED``; those that were there are replaced.

    ``reject`` is null if a row is sound: without nulls, with a finite value
    that isn't negative and positive degrees of freedom, of an expected
    modality, after its channel's last admitted row in sequence and time, with
    the same degrees of freedom. Of a frame's rows the earliest sound one of a channel counts. A
    sound row is ``discontinuous`` after a gap of sequence or time. With
    ``resets`` a frame that has one begins the track's next generation, and all
    its channels anew. A rejected row changes nothing.
    """
    kept = rows.select(*(c for c in rows.columns if c not in ADDED.names))
    ordered = kept.repartition("track_id").sortWithinPartitions("track_id", "seq", "timestamp_ms", "modality", "dof", "nis")
    schema = T.StructType([*kept.schema.fields, *ADDED.fields])
    kinds = {T.LongType(): pa.int64(), T.StringType(): pa.string(), T.BooleanType(): pa.bool_(), T.DoubleType(): pa.float64()}
    added = pa.schema([pa.field(f.name, kinds[f.dataType]) for f in ADDED.fields])
    run = lambda batches: _folded(batches, Fold(cfg, modalities, resets), added)
    return ordered.mapInArrow(run, schema).repartition("track_id")
