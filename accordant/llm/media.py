"""Media columns: payloads in ISO media containers, and their tables read back.

``pack`` stores a payload as uncompressed video of 8 by 8 pixels of 3 bytes, so
that each sample of 192 bytes is a frame. ``inspect`` walks the nested boxes of
any ISO media bytes and decodes each track's sample tables into codec, duration
and the byte ranges of keyframes; it never looks at sample bytes. Fragmented
files, whose samples lie outside these tables, are refused. Each document is one
value, so every step is a map over rows: no shuffle, and a lost executor's
slices are computed again.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from accordant.llm.common import slices, table, written

WIDTH = HEIGHT = 8
SAMPLE_BYTES = WIDTH * HEIGHT * 3
TIMESCALE, TICKS = 24_000, 1_001
#: Samples in a chunk, and every how many samples a keyframe stands.
CHUNK_SAMPLES, GROUP_SAMPLES = 256, 12
#: Boxes that hold boxes (fixed values of the format).
CONTAINERS = (b"moov", b"trak", b"mdia", b"minf", b"dinf", b"stbl", b"edts", b"udta", b"mvex", b"moof", b"traf")
IDENTITY = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def box(kind: bytes, *body: bytes) -> bytes:
    size = 8 + sum(map(len, body))
    if size >= 2**32:
        return struct.pack(">I4sQ", 1, kind, size + 8) + b"".join(body)
    return struct.pack(">I4s", size, kind) + b"".join(body)


def full_box(kind: bytes, *body: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *body)


def _moov(samples: int, data_at: int) -> bytes:
    media_ticks = samples * TICKS
    chunks = np.arange(-(-samples // CHUNK_SAMPLES), dtype=np.uint64) * np.uint64(CHUNK_SAMPLES * SAMPLE_BYTES) + np.uint64(data_at)
    last = samples - (len(chunks) - 1) * CHUNK_SAMPLES
    runs = [(1, CHUNK_SAMPLES, 1)] if last == CHUNK_SAMPLES or len(chunks) > 1 else []
    if last != CHUNK_SAMPLES:
        runs.append((len(chunks), last, 1))
    keys = np.arange(1, samples + 1, GROUP_SAMPLES, dtype=">u4")
    entry = box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(16), struct.pack(">HHIIIH", WIDTH, HEIGHT, 0x480000, 0x480000, 0, 1), bytes(32), struct.pack(">Hh", 24, -1))
    table_boxes = box(
        b"stbl",
        full_box(b"stsd", struct.pack(">I", 1), entry),
        full_box(b"stts", struct.pack(">III", 1, samples, TICKS)),
        full_box(b"stss", struct.pack(">I", len(keys)), keys.tobytes()),
        full_box(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs)),
        full_box(b"stsz", struct.pack(">II", SAMPLE_BYTES, samples)),
        full_box(b"co64", struct.pack(">I", len(chunks)), chunks.astype(">u8").tobytes()),
    )
    minf = box(b"minf", full_box(b"vmhd", bytes(8), flags=1), box(b"dinf", full_box(b"dref", struct.pack(">I", 1), full_box(b"url ", flags=1))), table_boxes)
    mdia = box(b"mdia", full_box(b"mdhd", struct.pack(">QQIQHH", 0, 0, TIMESCALE, media_ticks, 0x55C4, 0), version=1), full_box(b"hdlr", bytes(4), b"vide", bytes(12), b"frames\0"), minf)
    tkhd = full_box(b"tkhd", struct.pack(">QQIIQ", 0, 0, 1, 0, media_ticks), bytes(8), bytes(8), IDENTITY, struct.pack(">II", WIDTH << 16, HEIGHT << 16), version=1, flags=7)
    mvhd = full_box(b"mvhd", struct.pack(">QQIQ", 0, 0, TIMESCALE, media_ticks), struct.pack(">IHH", 0x10000, 0x100, 0), bytes(8), IDENTITY, bytes(24), struct.pack(">I", 2), version=1)
    return box(b"moov", mvhd, box(b"trak", tkhd, mdia))


def padded(payload: bytes) -> bytes:
    """The payload and spaces, up to a positive multiple of a sample."""
    return payload.ljust(max(1, -(-len(payload) // SAMPLE_BYTES)) * SAMPLE_BYTES, b" ")


def pack(payload: bytes) -> bytes:
    """A file of brands, tables and the padded payload as its samples, bit for bit."""
    data = padded(payload)
    brands = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomqt  ")
    samples = len(data) // SAMPLE_BYTES
    header = 16 if len(data) + 8 >= 2**32 else 8
    data_at = len(brands) + len(_moov(samples, 0)) + header
    return b"".join((brands, _moov(samples, data_at), box(b"mdat", data)))


def walk(media: bytes, start: int = 0, end: int | None = None, path: tuple[bytes, ...] = ()) -> Iterator[tuple[tuple[bytes, ...], int, int]]:
    """(path, start of the body, end) of every box, depth first. A box that runs past its parent raises ValueError."""
    end = len(media) if end is None else end
    while start + 8 <= end:
        size, kind = struct.unpack_from(">I4s", media, start)
        body = start + 8
        if size == 1:
            size, body = struct.unpack_from(">Q", media, body)[0], body + 8
        stop = end if size == 0 else start + size
        if stop > end or stop < body:
            raise ValueError(f"box {kind!r} at {start} leaves its parent")
        yield (*path, kind), body, stop
        if kind in CONTAINERS:
            yield from walk(media, body, stop, (*path, kind))
        start = stop


@dataclass(frozen=True)
class Track:
    handler: str  # vide, soun and so on
    codec: str
    width: int
    height: int
    timescale: int
    duration: int
    offsets: np.ndarray  # of samples, in the file
    sizes: np.ndarray
    keyframes: np.ndarray  # numbers of samples, from 0

    def keyframe_ranges(self) -> list[tuple[int, int]]:
        return [(int(self.offsets[k]), int(self.offsets[k] + self.sizes[k])) for k in self.keyframes]


def _sample_offsets(sizes: np.ndarray, chunk_offsets: np.ndarray, runs: np.ndarray) -> np.ndarray:
    firsts = np.append(runs[:, 0] - 1, len(chunk_offsets)).astype(np.int64)
    per_chunk = np.repeat(runs[:, 1].astype(np.int64), np.diff(firsts))
    chunk_of = np.repeat(np.arange(len(per_chunk)), per_chunk)
    if len(chunk_of) != len(sizes):
        raise ValueError(f"chunks hold {len(chunk_of)} samples, sizes {len(sizes)}")
    before = np.concatenate(([0], np.cumsum(sizes)[:-1])) if len(sizes) else sizes
    first_sample = np.concatenate(([0], np.cumsum(per_chunk)[:-1])).astype(np.int64)
    return chunk_offsets.astype(np.int64)[chunk_of] + before - before[first_sample][chunk_of]


def tracks(media: bytes) -> list[Track]:
    """Every track of a file, each from its own tables; one without sample tables, or a fragmented file, raises ValueError."""
    found: list[dict[bytes, tuple[int, int]]] = []
    for path, at, stop in walk(media):
        if path == (b"moof",) or path == (b"moov", b"mvex"):
            raise ValueError("the samples of a fragmented file aren't in its tables")
        if path == (b"moov", b"trak"):
            found.append({})
        elif path[:2] == (b"moov", b"trak"):
            found[-1].setdefault(path[-1], (at, stop))
    return [_track(media, tables) for tables in found]


def inspect(media: bytes, handler: str | None = None) -> Track:
    """The first track of a handler; without one the first video track, else the first of all. ValueError if there is none."""
    every = tracks(media)
    picked = [t for t in every if t.handler == (handler or "vide")] or ([] if handler else every)
    if not picked:
        raise ValueError("no track with sample tables")
    return picked[0]


def _track(media: bytes, tables: dict[bytes, tuple[int, int]]) -> Track:
    missing = [k for k in (b"mdhd", b"stsd", b"stts", b"stsc", b"stsz") if k not in tables]
    if missing or not tables.keys() & {b"stco", b"co64"}:
        raise ValueError(f"no track with sample tables: {missing or 'no chunk offsets'}")

    def fields(kind: bytes, form: str, skip: int) -> tuple:
        at, stop = tables[kind]
        if at + skip + struct.calcsize(form) > stop:
            raise ValueError(f"box {kind!r} is too short")
        return struct.unpack_from(form, media, at + skip)

    def numbers(kind: bytes, dtype: str, skip: int = 8, columns: int = 1) -> np.ndarray:
        at, stop = tables[kind]
        count = fields(kind, ">I", skip - 4)[0] * columns
        if at + skip + count * np.dtype(dtype).itemsize > stop:
            raise ValueError(f"box {kind!r} is too short for its entries")
        return np.frombuffer(media, dtype, count, at + skip)

    timescale, duration = fields(b"mdhd", ">IQ", 20) if fields(b"mdhd", ">B", 0)[0] == 1 else fields(b"mdhd", ">II", 12)
    entry_size, codec = fields(b"stsd", ">I4s", 8)
    handler = fields(b"hdlr", ">4s", 8)[0].decode("latin-1") if b"hdlr" in tables else ""
    width, height = fields(b"stsd", ">HH", 40) if entry_size >= 36 and handler in ("", "vide") else (0, 0)
    same, count = fields(b"stsz", ">II", 4)
    sizes = np.full(count, same, np.int64) if same else numbers(b"stsz", ">u4", 12).astype(np.int64)
    chunk_offsets = numbers(b"co64", ">u8") if b"co64" in tables else numbers(b"stco", ">u4")
    offsets = _sample_offsets(sizes, chunk_offsets, numbers(b"stsc", ">u4", 8, 3).reshape(-1, 3))
    keyframes = numbers(b"stss", ">u4").astype(np.int64) - 1 if b"stss" in tables else np.arange(count)
    if len(keyframes) and (keyframes.min() < 0 or keyframes.max() >= count):
        raise ValueError("a keyframe is no sample of its track")
    if len(offsets) and (offsets + sizes).max() > len(media):
        raise ValueError("a sample lies outside the file")
    return Track(handler, codec.decode("latin-1"), width, height, timescale, duration, offsets, sizes, keyframes)


def payload_of(media: bytes, track: Track) -> bytes:
    """All samples in order; one slice where they lie together."""
    if not len(track.offsets):
        return b""
    ends = track.offsets + track.sizes
    if (track.offsets[1:] == ends[:-1]).all():
        return media[track.offsets[0] : ends[-1]]
    return b"".join(media[a:b] for a, b in zip(track.offsets, ends, strict=True))


def packed(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, n_bytes (of the text, unpadded) and ``media``. A null text counts as empty: one sample of spaces."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            raw = [x or b"" for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, raw), pa.int64()), pa.array(map(pack, raw), pa.binary())], ["_key", "n_bytes", "media"])

    return docs.select(F.col(key).alias("_key"), F.col(text).cast("binary").alias("_text")).mapInArrow(run, f"_key {kind}, n_bytes bigint, media binary").withColumnRenamed("_key", key)


def described(media: DataFrame, key: str = "doc_id") -> DataFrame:
    """Codec, size, duration and keyframe byte ranges of media columns, with digests of payload and media.

    They are those of the track that ``inspect`` picks; ``n_tracks`` tells how many there are. Null media give nulls; bytes that aren't such a container fail the job, as the column is then not what it says.
    """
    kind = media.schema[key].dataType.simpleString()
    schema = pa.schema([("n_tracks", pa.int32()), ("codec", pa.string()), ("width", pa.int32()), ("height", pa.int32()), ("duration_s", pa.float64()), ("n_samples", pa.int64()), ("keyframe_ranges", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string())])

    def row(x: bytes | None) -> dict:
        if x is None:
            return {}
        every = tracks(x)
        track = next((t for t in every if t.handler == "vide"), every[0] if every else None) or inspect(x)
        payload = payload_of(x, track)
        return {
            "n_tracks": len(every), "codec": track.codec, "width": track.width, "height": track.height, "duration_s": track.duration / track.timescale if track.timescale else None, "n_samples": len(track.sizes),
            "keyframe_ranges": [{"start": a, "end": b} for a, b in track.keyframe_ranges()], "payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-16:]), "media_bytes": len(x), "media_sha256": hashlib.sha256(x).hexdigest(),
        }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = pa.RecordBatch.from_pylist([row(x) for x in batch.column(2).to_pylist()], schema)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *out.columns], ["_key", "n_bytes", *schema.names])

    ddl = "n_tracks int, codec string, width int, height int, duration_s double, n_samples bigint, keyframe_ranges array<struct<start: bigint, end: bigint>>, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string"
    return media.select(F.col(key).alias("_key"), "n_bytes", "media").mapInArrow(run, f"_key {kind}, n_bytes bigint, {ddl}").withColumnRenamed("_key", key)


def op6_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document packed into a container, stored in the shared folder, read back and described."""
    stored = written(packed(table(spark, sf_dir, "documents")), "media")
    seen = described(stored)
    ranges = F.xxhash64("keyframe_ranges")
    feature = F.format_string("%s %dx%d %.6fs %d samples %d keyframes %016x", "codec", "width", "height", "duration_s", "n_samples", F.size("keyframe_ranges"), ranges)
    return seen.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))
