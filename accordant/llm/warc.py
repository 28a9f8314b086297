r"""WARC archives: writing, reading, and reassembly of segmented records.

A payload is stored once: of records with equal payloads of at least
``MIN_REVISIT_BYTES`` bytes the one with the smallest id is a response and the
others revisit it. The block of a response is an HTTP message with chunked
transfer framing; blocks longer than ``SEGMENT_BYTES`` are written as a first
record and continuations, as WARC 1.1 lays down. Reading groups the segments
of a record by their origin's identifier, puts them in order by segment
number, verifies the total length and takes the chunked framing off.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from accordant.llm.common import read_file, slices, table, workspace, write_file, written

MIN_REVISIT_BYTES = 100
SEGMENT_BYTES = 16_384
#: Bytes of a frame of the chunked transfer encoding.
FRAME_BYTES = 8_192
#: Compressed bytes that are looked at together when archives are read.
FEED_BYTES = 4_096
#: Bytes of payload after which a task begins another archive file.
ARCHIVE_BYTES = 64 << 20
#: Tasks that archives are read in at most; each reads its files one after another.
MOST_TASKS = 20_000
DATE = "2024-01-01T00:00:00Z"
#: Fixed values of the format.
VERSION = b"WARC/1.1\r\n"
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"


def chunked(payload: bytes, frame: int = FRAME_BYTES) -> bytes:
    parts = [b"%x\r\n%b\r\n" % (len(x), x) for x in (payload[i : i + frame] for i in range(0, len(payload), frame))]
    return b"".join(parts) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    """Take chunked framing off; extensions after a size and trailers are allowed. Broken framing raises ValueError."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if size == 0:
            return b"".join(out)
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk doesn't end where its size says")
        out.append(body[at : at + size])
        at += size + 2


def http_payload(block: bytes) -> bytes:
    """The payload of an HTTP message."""
    head, gap, body = block.partition(b"\r\n\r\n")
    if not gap:
        raise ValueError("an HTTP message without an end of its head")
    fields = dict(x.lower().split(b":", 1) for x in head.split(b"\r\n")[1:])
    return unchunked(body) if b"chunked" in fields.get(b"transfer-encoding", b"") else body


def record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    """A record as a gzip member of its own, so that archives can be cut between records."""
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))])
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(VERSION + head.encode() + b"\r\n" + block + b"\r\n\r\n") + packer.flush()


def records_of(key: str, url: str, payload: bytes, digest: str, refers_to: str | None, segment: int = SEGMENT_BYTES) -> Iterator[bytes]:
    """The record or records of one payload."""
    own = [("WARC-Date", DATE), ("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")), ("WARC-Payload-Digest", f"sha256:{digest}")]
    if refers_to is not None:
        yield record([("WARC-Type", "revisit"), ("WARC-Record-ID", f"<{key}>"), *own, ("WARC-Profile", IDENTICAL), ("WARC-Refers-To", f"<{refers_to}>"), ("Content-Type", "application/http; msgtype=response")], HTTP_HEAD + b"\r\n")
        return
    block = HTTP_HEAD + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    first = [("WARC-Type", "response"), ("WARC-Record-ID", f"<{key}>"), *own, ("Content-Type", "application/http; msgtype=response")]
    pieces = [block[i : i + segment] for i in range(0, len(block), segment)]
    if len(pieces) == 1:
        yield record(first, block)
        return
    for n, piece in enumerate(pieces, 1):
        total = [("WARC-Segment-Total-Length", str(len(block)))] if n == len(pieces) else []
        if n == 1:
            yield record([*first, ("WARC-Segment-Number", "1")], piece)
        else:
            yield record([("WARC-Type", "continuation"), ("WARC-Record-ID", f"<{key}:{n}>"), ("WARC-Date", DATE), ("WARC-Segment-Origin-ID", f"<{key}>"), ("WARC-Segment-Number", str(n)), *total], piece)


def parse_archive(raw: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields with lower-case names, block) of each record of an archive of gzip members, or of a plain one."""
    if raw[:2] != b"\x1f\x8b":
        yield from _parse_plain(raw)
        return
    at, view = 0, memoryview(raw)
    while at < len(raw):
        opened, plain = zlib.decompressobj(31), []
        while not opened.eof:
            if at >= len(raw):
                raise ValueError("an archive ends inside a record")
            fed = view[at : at + FEED_BYTES]
            plain.append(opened.decompress(fed))
            at += len(fed)
        at -= len(opened.unused_data)
        yield from _parse_plain(b"".join(plain))


def _parse_plain(raw: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    at = 0
    while at < len(raw):
        end = raw.index(b"\r\n\r\n", at)
        lines = raw[at:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record begins at {at}")
        fields = {k.strip().lower(): v.strip() for k, v in (x.split(":", 1) for x in lines[1:])}
        size = int(fields["content-length"])
        yield fields, raw[end + 4 : end + 4 + size]
        at = end + 4 + size
        if raw[at : at + 4] != b"\r\n\r\n":
            raise ValueError("a record doesn't end where its length says")
        at += 4


def identified(pages: DataFrame, page: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """key, url, payload, digest and refers_to (the key of the response, null for responses).

    A key is "urn:page:<id>:<copy>:<hash of the url>:<hash of the payload>", so
    it is told by the row's own values and by no place in a scan. Rows that
    agree in id, url and html are copies 0, 1 and so on of one of them: such
    rows are counted, kept once and written as often as they were. A null html
    or url counts as empty. Null ids give an empty id and come last among equal
    payloads. Only ids and digests are grouped; what is joined back is a row
    for each digest or row that repeats.
    """
    rows = pages.select(
        F.col(page).cast("long").alias("_page"),
        F.coalesce(F.col(url), F.lit("")).alias("url"),
        F.coalesce(F.col(html), F.lit("")).cast("binary").alias("payload"),
    ).withColumn("digest", F.sha2("payload", 256))
    same = ("_page", "url", "digest")
    counted = written(rows.groupBy(*same, F.length("payload").alias("_bytes")).agg(F.count("*").alias("_copies")), "warc-rows")
    order = F.struct(F.col("_page").isNull().alias("none"), F.coalesce("_page", F.lit(0)).alias("page"), F.col("url").alias("url"))
    repeated = counted.filter(F.col("_bytes") >= min_bytes).groupBy("digest").agg(F.min(order).alias("_first"), F.sum("_copies").alias("_n"))
    # Written first, so that sizes are known when joins are planned: small tables are broadcast and pages aren't shuffled.
    repeated = written(repeated.filter("_n > 1").select("digest", "_first"), "warc-repeated")
    again = written(counted.filter("_copies > 1").select(*(F.col(c).alias(f"_{c}") for c in same), "_copies"), "warc-again")
    is_again = reduce(lambda x, y: x & y, (rows[c].eqNullSafe(again[f"_{c}"]) for c in same))
    once = rows.join(again, is_again, "left_anti").withColumn("_copy", F.lit(0).cast("long"))
    some = rows.join(again, is_again).select(*rows.columns, "_copies").dropDuplicates(list(same))
    copies = some.withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_copies") - 1))).drop("_copies")

    def name(page_col: Column, copy: Column, url_col: Column) -> Column:
        hashed = [F.lower(F.hex(F.xxhash64(url_col))), F.substring("digest", 1, 16)]
        return F.concat_ws(":", F.lit("urn:page"), F.coalesce(page_col.cast("string"), F.lit("")), copy.cast("string"), *hashed)

    joined = once.unionByName(copies).join(repeated, "digest", "left")
    is_first = F.col("_first.page").eqNullSafe(F.coalesce("_page", F.lit(0))) & F.col("_first.none").eqNullSafe(F.col("_page").isNull())
    is_first = is_first & F.col("_first.url").eqNullSafe(F.col("url")) & (F.col("_copy") == 0)
    first = name(F.when(~F.col("_first.none"), F.col("_first.page")), F.lit(0), F.col("_first.url"))
    refers_to = F.when(F.col("_first").isNotNull() & ~is_first, first)
    return joined.select(name(F.col("_page"), F.col("_copy"), F.col("url")).alias("key"), "url", "payload", "digest", refers_to.alias("refers_to"))


def write_archives(rows: DataFrame, folder: str, segment: int = SEGMENT_BYTES) -> DataFrame:
    """Write archives of the rows of ``identified``; the table of their names. A repeated task writes the same names again."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, parts, size = TaskContext.get().partitionId(), 0, [], 0

        def close() -> pa.RecordBatch:
            nonlocal number, parts, size
            name = f"part-{part:06d}-{number:04d}.warc.gz"
            write_file(f"{folder}/{name}", iter(parts))
            number, parts, size = number + 1, [], 0
            return pa.RecordBatch.from_pydict({"name": pa.array([name])})

        for batch in slices(batches):
            for key, url, payload, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for raw in records_of(key, url, payload, digest, refers_to, segment):
                    parts.append(raw)
                    size += len(raw)
                if size >= ARCHIVE_BYTES:
                    yield close()
        if parts:
            yield close()

    return written(rows.mapInArrow(write, "name string"), "warc-names")


def _spread(names: DataFrame) -> DataFrame:
    """Names of files dealt to tasks, about one each up to MOST_TASKS tasks."""
    return names.repartition(max(1, min(MOST_TASKS, names.count())), "name")


RECORD = pa.schema([("key", pa.string()), ("type", pa.string()), ("refers_to", pa.string()), ("declared", pa.string()), ("segment", pa.int32()), ("total", pa.int64()), ("block", pa.binary())])
RECORD_DDL = "key string, type string, refers_to string, declared string, segment int, total bigint, block binary"


def read_records(names: DataFrame, folder: str) -> DataFrame:
    """A row a record; ``segment`` is null for records that aren't segmented, and a continuation's key is its origin's."""
    return _spread(names).mapInArrow(_reader(folder), RECORD_DDL)


def _reader(folder: str) -> Callable:
    bare = lambda x: x[1:-1] if x else None

    def told(rows: list[tuple]) -> pa.RecordBatch:
        columns = [pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), RECORD, strict=True)]
        return pa.RecordBatch.from_arrays(columns, schema=RECORD)

    def row(f: dict[str, str], block: bytes) -> tuple:
        number, total = f.get("warc-segment-number"), f.get("warc-segment-total-length")
        key = bare(f.get("warc-segment-origin-id")) or bare(f["warc-record-id"])
        declared = f.get("warc-payload-digest", "").removeprefix("sha256:")
        return key, f["warc-type"], bare(f.get("warc-refers-to")), declared, number and int(number), total and int(total), block

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows: list[tuple] = []
                for f, block in parse_archive(read_file(f"{folder}/{name}")):
                    rows.append(row(f, block))
                    if len(rows) == 256:
                        yield told(rows)
                        rows = []
                if rows:
                    yield told(rows)

    return read


def reassembled(records: DataFrame) -> DataFrame:
    """One row a record: key, type, refers_to, declared and the whole ``block``.

    Segments are grouped by origin; a group is one record, so it is as large
    as that record. Missing or repeated segments and a wrong total length
    raise an error.
    """
    whole = records.filter(F.col("segment").isNull()).select("key", "type", "refers_to", "declared", "block")
    grouped = records.filter(F.col("segment").isNotNull()).groupBy("key").agg(
        F.max(F.when(F.col("segment") == 1, F.col("type"))).alias("type"), F.max(F.when(F.col("segment") == 1, F.col("refers_to"))).alias("refers_to"), F.max(F.when(F.col("segment") == 1, F.col("declared"))).alias("declared"),
        F.max("total").alias("total"), F.sum(F.octet_length("block")).alias("bytes"), F.max("segment").alias("last"), F.count("*").alias("n"), F.countDistinct("segment").alias("different"),
        F.unhex(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("segment", F.hex("block").alias("h")))), lambda x: x["h"]), "")).alias("block"),
    )
    sound = (F.col("total") == F.col("bytes")) & (F.col("last") == F.col("n")) & (F.col("different") == F.col("n"))
    checked = grouped.withColumn("block", F.when(F.coalesce(sound, F.lit(False)), F.col("block")).otherwise(F.raise_error(F.concat(F.lit("segments don't make up the record "), "key")).cast("binary")))
    return whole.unionByName(checked.select(whole.columns))


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns key, type, refers_to, declared, segment, total and block: add payload_bytes and payload_digest of records that are whole, and drop their blocks."""
    for batch in slices(batches):
        sizes, digests, blocks = [], [], []
        for key, kind, declared, segment, block in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3, 4, 6)), strict=True):
            payload = None if kind == "revisit" or segment is not None else http_payload(block)
            sizes.append(None if payload is None else len(payload))
            digests.append(declared if payload is None else hashlib.sha256(payload).hexdigest())
            blocks.append(None if segment is None else block)
            if payload is not None and declared and digests[-1] != declared:
                raise ValueError(f"the payload of {key} hasn't the digest that is declared")
        yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(blocks, pa.binary()), pa.array(sizes, pa.int64()), pa.array(digests, pa.string())], [*batch.schema.names[:6], "block", "payload_bytes", "payload_digest"])


SEEN_DDL = f"{RECORD_DDL}, payload_bytes bigint, payload_digest string"
SEEN = ("key", "type", "refers_to", "payload_bytes", "payload_digest")


def payloads(records: DataFrame) -> DataFrame:
    """key, type, refers_to, payload_bytes and payload_digest of whole records; revisits have the digest that they declare.

    A payload whose digest isn't the declared one raises an error.
    """
    ready = records.select("key", "type", "refers_to", "declared", F.lit(None).cast("int").alias("segment"), F.lit(None).cast("long").alias("total"), "block")
    return ready.mapInArrow(_digested, SEEN_DDL).select(*SEEN)


def read_payloads(names: DataFrame, folder: str) -> DataFrame:
    """``payloads`` of archives that are read once: whole records give their digests there and then, only segments go on to be put together."""
    read = _reader(folder)
    seen = written(_spread(names).mapInArrow(lambda b: _digested(read(b)), SEEN_DDL), "warc-records")
    whole = seen.filter(F.col("segment").isNull()).select(*SEEN)
    return whole.unionByName(payloads(reassembled(seen.filter(F.col("segment").isNotNull()))))


def pages_of(seen: DataFrame) -> DataFrame:
    """The rows of ``payloads`` with revisits resolved."""
    page = lambda c: F.split(c, ":")[2].try_cast("long")
    revisits = seen.filter(F.col("type") == "revisit")
    responses = seen.filter(F.col("type") == "response")
    targets = responses.join(revisits.select(F.col("refers_to").alias("key")).distinct(), "key", "left_semi").select(F.col("key").alias("refers_to"), F.col("payload_bytes").alias("_bytes"), F.col("payload_digest").alias("_digest"))
    found = revisits.join(targets, "refers_to", "left").select("key", "type", "refers_to", F.col("_bytes").alias("payload_bytes"), F.when(F.col("_digest") == F.col("payload_digest"), F.col("_digest")).otherwise(F.raise_error(F.lit("a revisit refers to no response with its digest")).cast("string")).alias("payload_digest"))
    return responses.unionByName(found).select(page(F.col("key")).alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), page(F.col("refers_to")).alias("refers_to"))


def op3_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = workspace(spark, "warc")
    names = write_archives(identified(table(spark, sf_dir, "pages")), folder)
    return pages_of(read_payloads(names, folder))


ORACLE = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND first_id <> page_id THEN first_id END AS refers_to
FROM f
"""
