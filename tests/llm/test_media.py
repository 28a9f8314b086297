import hashlib
import struct
import zlib

import numpy as np
import pytest

from accordant.llm import media


@pytest.mark.parametrize("n", [0, 1, 191, 192, 193, 192 * 256, 192 * 256 + 1, 192 * 700 + 5])
def test_round_trip_is_bit_for_bit(n):
    payload = np.random.default_rng(n).integers(0, 256, n, np.uint8).tobytes()
    packed = media.pack(payload)
    track = media.inspect(packed)
    assert media.payload_of(packed, track) == media.padded(payload)
    assert len(media.padded(payload)) % 192 == 0 and len(media.padded(payload)) > 0
    assert (track.codec, track.width, track.height) == ("raw ", 8, 8)
    for k, (a, b) in zip(track.keyframes, track.keyframe_ranges(), strict=True):
        assert packed[a:b] == media.padded(payload)[k * 192 : k * 192 + 192]


def test_scattered_chunks_and_varied_sizes():
    samples = [b"a" * 5, b"b" * 7, b"c" * 3, b"d" * 2]
    gap = b"GAP"
    data = samples[0] + samples[1] + gap + samples[2] + gap + samples[3]
    stbl = media.box(
        b"stbl", media.full_box(b"stsd", struct.pack(">I", 1), media.box(b"avc1", bytes(24), struct.pack(">HH", 640, 480), bytes(10))), media.full_box(b"stts", struct.pack(">III", 1, 4, 10)),
        media.full_box(b"stsc", struct.pack(">I", 2), struct.pack(">III", 1, 2, 1), struct.pack(">III", 2, 1, 1)), media.full_box(b"stsz", struct.pack(">II", 0, 4), struct.pack(">4I", 5, 7, 3, 2)),
        media.full_box(b"stco", struct.pack(">I", 3), struct.pack(">3I", 8, 8 + 15, 8 + 21)), media.full_box(b"stss", struct.pack(">I", 2), struct.pack(">2I", 1, 3)),
    )
    mdia = media.box(b"mdia", media.full_box(b"mdhd", struct.pack(">IIIIHH", 0, 0, 100, 40, 0, 0)), media.box(b"minf", stbl))
    file = media.box(b"mdat", data) + media.box(b"moov", media.box(b"trak", mdia))
    track = media.inspect(file)
    assert media.payload_of(file, track) == b"".join(samples)
    assert track.keyframe_ranges() == [(8, 13), (23, 26)]
    assert (track.codec, track.width, track.height, track.duration / track.timescale) == ("avc1", 640, 480, 0.4)


def a_track(handler, samples, at, keys=None, wide=False, timescale=100):
    """A trak box whose samples lie one after another from ``at``, each a chunk."""
    sizes = [len(x) for x in samples]
    places = [at + sum(sizes[:i]) for i in range(len(sizes))]
    offsets = media.full_box(b"co64", struct.pack(f">I{len(places)}Q", len(places), *places)) if wide else media.full_box(b"stco", struct.pack(f">I{len(places)}I", len(places), *places))
    boxes = [
        media.full_box(b"stsd", struct.pack(">I", 1), media.box(b"avc1" if handler == b"vide" else b"mp4a", bytes(24), struct.pack(">HH", 640, 480), bytes(10))),
        media.full_box(b"stts", struct.pack(">III", 1, len(sizes), 10)), media.full_box(b"stsc", struct.pack(">IIII", 1, 1, 1, 1)),
        media.full_box(b"stsz", struct.pack(f">II{len(sizes)}I", 0, len(sizes), *sizes)), offsets,
    ]
    if keys is not None:
        boxes.append(media.full_box(b"stss", struct.pack(f">I{len(keys)}I", len(keys), *keys)))
    mdia = media.box(b"mdia", media.full_box(b"mdhd", struct.pack(">IIIIHH", 0, 0, timescale, len(sizes) * 10, 0, 0)), media.full_box(b"hdlr", bytes(4), handler, bytes(13)), media.box(b"minf", media.box(b"stbl", *boxes)))
    return media.box(b"trak", mdia)


@pytest.mark.parametrize("video_first", [True, False])
def test_each_track_has_its_own_tables(video_first):
    """Sound without keyframe table and 32-bit offsets beside video with both others: nothing is mixed."""
    sound, video = [b"s" * n for n in (5, 6, 7, 8)], [b"v" * n for n in (50, 3, 2, 40, 1)]
    data = b"".join(sound) + b"".join(video)
    two = [a_track(b"soun", sound, 8, timescale=50), a_track(b"vide", video, 8 + 26, keys=[1, 4], wide=True)]
    file = media.box(b"mdat", data) + media.box(b"moov", *(two[::-1] if video_first else two))
    picked = media.inspect(file)
    assert (picked.handler, picked.codec, picked.width, picked.timescale) == ("vide", "avc1", 640, 100)
    assert media.payload_of(file, picked) == b"".join(video) and picked.keyframe_ranges() == [(34, 84), (89, 129)]
    other = media.inspect(file, "soun")
    assert (other.codec, other.width, other.duration / other.timescale) == ("mp4a", 0, 0.8)
    assert media.payload_of(file, other) == b"".join(sound) and other.keyframes.tolist() == [0, 1, 2, 3]
    assert len(media.tracks(file)) == 2
    with pytest.raises(ValueError):
        media.inspect(file, "text")


def test_what_tables_dont_tell_is_refused():
    sound = [b"ab", b"c"]
    moov = lambda *boxes: media.box(b"mdat", b"abc") + media.box(b"moov", *boxes)
    assert media.inspect(moov(a_track(b"soun", sound, 8))).sizes.tolist() == [2, 1]
    for bad in (
        moov(a_track(b"soun", sound, 8), media.box(b"mvex")),
        moov(a_track(b"soun", sound, 8)) + media.box(b"moof", media.box(b"traf")),
        moov(a_track(b"soun", sound, 8, keys=[3])),
        moov(a_track(b"soun", sound, 8_000)),
        moov(a_track(b"soun", sound, 8).replace(b"stsz" + bytes(8) + struct.pack(">I", 2), b"stsz" + bytes(8) + struct.pack(">I", 2_000_000))),
        moov(media.box(b"trak")),
    ):
        with pytest.raises(ValueError):
            media.inspect(bad)


def test_the_query_by_an_independent_reading(spark):
    """Payloads cut out of the stored bytes without the walker: after the last 'mdat', bit for bit the padded text."""
    rows = [(i, "é" * n) for i, n in enumerate((0, 1, 96, 97, 5_000))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    stored = {r.doc_id: bytes(r.media) for r in media.packed(docs).collect()}
    told = {r.doc_id: r for r in media.described(media.packed(docs)).collect()}
    for i, text in rows:
        raw = text.encode()
        want = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
        cut = stored[i][stored[i].rindex(b"mdat") + 4 :]
        assert cut == want and (told[i].payload_bytes, told[i].media_bytes, told[i].n_tracks) == (len(want), len(stored[i]), 1)
        assert told[i].media_sha256 == hashlib.sha256(stored[i]).hexdigest()
        assert [(k.start, k.end) for k in told[i].keyframe_ranges][:1] == [(len(stored[i]) - len(want), len(stored[i]) - len(want) + 192)]


def test_damaged_boxes_are_refused():
    for damaged in (b"", b"\0\0\0\x20moov", media.pack(b"x")[:100]):
        with pytest.raises(ValueError):
            media.inspect(damaged)


def test_columns(spark):
    rows = [(1, "héllo"), (None, None), (2, ""), (2, ""), (3, "z" * 100_000)]
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, media string, n_bytes int")
    got = media.described(media.packed(docs)).collect()
    want = sorted((r[0] or 0, len((r[1] or "").encode()), hashlib.sha256(media.padded((r[1] or "").encode())).hexdigest(), zlib.crc32(media.padded((r[1] or "").encode())[-16:])) for r in rows)
    assert sorted((r.doc_id or 0, r.n_bytes, r.payload_sha256, r.tail_crc32) for r in got) == want
    assert media.described(media.packed(docs.limit(0))).count() == 0
