import hashlib

import pytest
from pyspark.sql import functions as F

from accordant.llm import warc
from accordant.llm.common import workspace


def through(spark, rows, segment=64):
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, payload string")
    folder = workspace(spark, "w")
    names = warc.write_archives(warc.identified(pages), folder, segment)
    one, two = (warc.pages_of(x) for x in (warc.read_payloads(names, folder), warc.payloads(warc.reassembled(warc.read_records(names, folder)))))
    assert sorted(map(str, one.collect())) == sorted(map(str, two.collect()))
    return one


def test_round_trip(spark):
    big, small = "é" * 400, "short"
    rows = [(3, "http://a/", big), (1, "http://b/\r\nX: y", big), (2, None, big), (1, "http://b/", big), (5, "u", small), (4, "u", small), (6, "u", None), (7, "u", ""), (None, "u", big), (None, None, None), (8, "u", "x" * 100), (9, "u", "x" * 100), (10, "u", "\r\n0\r\n\r\nWARC/1.1\r\n" * 30)]
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in through(spark, rows).collect()), key=str)
    want = []
    seen_first = False
    for page, _, html in rows:
        raw = (html or "").encode()
        kind, refers = "response", None
        if html == big and not (page == 1 and not seen_first):
            kind, refers = "revisit", 1
        elif html == big:
            seen_first = True
        if page == 9:
            kind, refers = "revisit", 8
        want.append((page, len(raw), hashlib.sha256(raw).hexdigest(), kind, refers))
    assert got == sorted(want, key=str)


def test_rows_that_agree_in_all_columns(spark):
    """Of equal rows one is the response and the others revisit it; equal small ones are all responses. Keys are unique and the same in each run."""
    big = "y" * 300
    rows = [(1, "u", big)] * 5 + [(2, "u", big), (None, None, big), (None, None, big), (3, "u", "s"), (3, "u", "s"), (None, None, None), (None, None, None)]
    got = through(spark, rows).collect()
    assert len(got) == len(rows)
    large = [r for r in got if r.payload_bytes == 300]
    assert sorted((r.page_id or 0, r.record_type, r.refers_to or 0) for r in large) == [(0, "revisit", 1)] * 2 + [(1, "response", 0)] + [(1, "revisit", 1)] * 4 + [(2, "revisit", 1)]
    assert [r.record_type for r in got if r.payload_bytes < 300] == ["response"] * 4
    make = lambda r, n: warc.identified(spark.createDataFrame(r, "page_id long, url string, html string").repartition(n))
    keys = [sorted((r.key, str(r.refers_to)) for r in make(x, n).collect()) for x, n in ((rows, 1), (rows[::-1], 5))]
    assert keys[0] == keys[1] and len({k for k, _ in keys[0]}) == len(rows)


def test_empty_table(spark):
    assert through(spark, []).count() == 0


def test_segments_in_any_order_and_missing_ones(spark):
    payload = b"0123456789" * 50
    block = warc.HTTP_HEAD + b"Transfer-Encoding: chunked\r\n\r\n" + warc.chunked(payload, 7)
    parts = [block[i : i + 50] for i in range(0, len(block), 50)]
    rows = [("k", "response" if n == 1 else "continuation", None, "", n, len(block) if n == len(parts) else None, p) for n, p in enumerate(parts, 1)]
    make = lambda r: spark.createDataFrame(r[::-1], warc.RECORD_DDL).repartition(4)
    one = warc.payloads(warc.reassembled(make(rows))).collect()[0]
    assert (one.payload_bytes, one.payload_digest) == (len(payload), hashlib.sha256(payload).hexdigest())
    for broken in (rows[:-1], rows[:3] + rows[4:], rows + rows[3:4]):
        with pytest.raises(Exception, match="segments don't make up"):
            warc.reassembled(make(broken)).select(F.sum(F.length("block"))).collect()


def test_framing():
    assert warc.unchunked(b"3;x=y\r\nabc\r\n1\r\nd\r\n0\r\nTrailer: z\r\n\r\n") == b"abcd"
    for broken in (b"4\r\nabc\r\n0\r\n\r\n", b"zz\r\n"):
        with pytest.raises(ValueError):
            warc.unchunked(broken)
