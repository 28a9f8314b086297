r"""Byte-level BPE encoding by overlapping chunks, and decoding.

A long text is cut into chunks that overlap. Chunks are pre-tokenised in
parallel; two neighbours are stitched at the first place in their overlap where
both have a pre-token boundary, and the pieces between such places are encoded
in parallel. Decoding concatenates the raw bytes of the ids.

Why a common boundary is enough: the pattern looks ahead but never back, so
what follows a true boundary doesn't depend on what came before. A boundary of
the left chunk is true if three more characters of the chunk follow it (no
match looks further), and from a true boundary on the right chunk's are true.
A place after white space isn't used, as `\s+(?!\S)` at the end of a piece
would take what it leaves in a whole text. Texts whose neighbours share no
such place (a run without boundaries longer than the overlap) are encoded whole.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from accordant.llm.common import bound_batches, slices, table

CHUNK_CHARS = 32_768
OVERLAP_CHARS = 512
#: Characters after a boundary that any match can have looked at.
LOOKAHEAD = 3


def default_vocabulary() -> tuple[str, str]:
    """The rank file and the pattern of the public tokenizer that the queries use."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@functools.lru_cache(maxsize=2)
def encoder(ranks_path: str, pattern: str) -> tiktoken.Encoding:
    """One encoder a Python worker; the rank file is on every worker, as the library that it comes with is."""
    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def boundaries(text: str, pattern: str) -> list[int]:
    """Where pre-tokens end."""
    return [m.end() for m in regex.finditer(pattern, text)]


def _ids(enc: tiktoken.Encoding, text: str) -> np.ndarray:
    return np.asarray(enc.encode_ordinary(text), dtype="<u4")


def encode_column(batches: Iterator[pa.RecordBatch], ranks_path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    """Replace the last column, text, by ``ids``: little-endian unsigned 32-bit integers."""
    enc = encoder(ranks_path, pattern)
    for batch in slices(batches):
        ids = [_ids(enc, x or "").tobytes() for x in batch.column(batch.num_columns - 1).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(ids, pa.binary())], [*batch.schema.names[:-1], "ids"])


def _pretokenised(batches: Iterator[pa.RecordBatch], pattern: str, chunk: int, overlap: int) -> Iterator[pa.RecordBatch]:
    """Add to chunks (columns _at and _text) the places, counted from the text's start, at which their left and right overlaps can be cut."""
    for batch in slices(batches, 16):
        left, right = [], []
        for at, text in zip(batch.column("_at").to_pylist(), batch.column("_text").to_pylist(), strict=True):
            usable = [p for p in boundaries(text, pattern) if p <= len(text) - LOOKAHEAD and not text[p - 1].isspace()]
            left.append([at + p for p in usable if p <= overlap])
            right.append([at + p for p in usable if p >= chunk])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(left, pa.list_(pa.int64())), pa.array(right, pa.list_(pa.int64()))], [*batch.schema.names, "_left", "_right"])


def chunked_pieces(rows: DataFrame, key: list[str], text: str, pattern: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> DataFrame:
    """Cut texts into pieces (key, _no, _text) that can be encoded one by one; a text that can't be cut is one piece."""
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(chunk))
    chunks = rows.select(*key, F.posexplode(starts).alias("_no", "_at"), text).select(*key, "_no", F.col("_at").cast("long").alias("_at"), F.substring(F.col(text), F.col("_at") + 1, F.lit(chunk + overlap)).alias("_text"))
    spread = chunks.repartition(*key, "_no")
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in spread.schema)}, _left array<bigint>, _right array<bigint>"
    cut = spread.mapInArrow(lambda b: _pretokenised(b, pattern, chunk, overlap), schema)
    order = Window.partitionBy(*key).orderBy("_no")
    ended = cut.withColumn("_last", F.lead("_no").over(order).isNull()).withColumn("_end", F.array_min(F.array_intersect("_right", F.lead("_left").over(order))))
    every = Window.partitionBy(*key)
    placed = ended.withColumns(
        {
            "_from": F.coalesce(F.lag("_end").over(order), F.lit(0)),
            "_whole": F.max(~F.col("_last") & F.col("_end").isNull()).over(every),
        }
    )
    size = F.when(F.col("_last"), F.length("_text")).otherwise(F.col("_end") - F.col("_from")).cast("int")
    cut_out = F.substring(F.col("_text"), (F.col("_from") - F.col("_at") + 1).cast("int"), size)
    # A text that lacks a common boundary is put together again: its chunks without their overlaps are one piece.
    own = F.when(F.col("_last"), F.col("_text")).otherwise(F.substring("_text", 1, chunk))
    parts = placed.select(
        *key,
        F.when(F.col("_whole"), 0).otherwise(F.col("_no")).alias("_piece"),
        F.struct("_no", F.when(F.col("_whole"), own).otherwise(cut_out).alias("t")).alias("_part"),
    )
    joined = F.array_join(F.transform(F.sort_array(F.collect_list("_part")), lambda x: x["t"]), "")
    return parts.groupBy(*key, "_piece").agg(joined.alias("_text")).withColumnRenamed("_piece", "_no")


def encode(docs: DataFrame, key: list[str], text: str = "text", ranks_path: str | None = None, pattern: str | None = None, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> DataFrame:
    """Encode whole texts: key columns and ``ids`` (binary, little-endian unsigned 32-bit integers).

    A null text counts as empty and has no ids. Nulls, ties and repeated rows
    in the key are kept, a row out for each row in; other columns are left
    out, so they can't clash. Texts of up to ``chunk`` characters are one
    chunk and need no shuffle; only pieces of longer ones are shuffled.
    """
    return _encoded(docs, key, text, ranks_path, pattern, chunk, overlap, None, "ids binary")


def _encoded(docs: DataFrame, key: list[str], text: str, ranks_path: str | None, pattern: str | None, chunk: int, overlap: int, then: Callable | None, result: str) -> DataFrame:
    """``then`` turns batches of keys and ids into ``result``; for texts of one chunk in the same Python worker that encodes them."""
    ranks_path, pattern = (a or b for a, b in zip((ranks_path, pattern), default_vocabulary(), strict=True))
    own = [f"_k{i}" for i in range(len(key))]
    rows = docs.select(*(F.col(k).alias(o) for k, o in zip(key, own, strict=True)), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    head = ", ".join(f"{o} {types[o]}" for o in own)
    run = lambda b: encode_column(b, ranks_path, pattern)
    both = run if then is None else lambda b: then(run(b), ranks_path, pattern)
    short = rows.filter(F.length("_text") <= chunk).mapInArrow(both, f"{head}, {result}")
    long_rows = rows.filter(F.length("_text") > chunk).withColumn("_row", F.monotonically_increasing_id())
    pieces = chunked_pieces(long_rows, [*own, "_row"], "_text", pattern, chunk, overlap)
    parts = pieces.repartition(*own, "_row", "_no").mapInArrow(run, f"{head}, _row bigint, _no int, ids binary")
    # hex, as Spark joins strings but not binaries of an array; these are long texts only
    joined = parts.groupBy(*own, "_row").agg(F.unhex(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_no", F.hex("ids").alias("h")))), lambda x: x["h"]), "")).alias("ids")).drop("_row")
    if then is not None:
        joined = joined.mapInArrow(lambda b: then(b, ranks_path, pattern), f"{head}, {result}")
    return short.unionByName(joined).withColumnsRenamed(dict(zip(own, key, strict=True)))


def decode_bytes(ids: bytes, enc: tiktoken.Encoding) -> bytes:
    return enc.decode_bytes(np.frombuffer(ids, "<u4").tolist())


def digests(batches: Iterator[pa.RecordBatch], ranks_path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    """Replace the last column, ids, by n_tokens, ids_sha256 and decoded_sha256."""
    enc = encoder(ranks_path, pattern)
    for batch in slices(batches):
        ids = [x or b"" for x in batch.column(batch.num_columns - 1).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:-1], pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in ids]), pa.array([hashlib.sha256(decode_bytes(x, enc)).hexdigest() for x in ids])],
            [*batch.schema.names[:-1], "n_tokens", "ids_sha256", "decoded_sha256"],
        )


def encode_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each document."""
    bound_batches(docs.sparkSession)
    return _encoded(docs, ["doc_id"], "text", None, None, CHUNK_CHARS, OVERLAP_CHARS, digests, "n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def op2_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(table(spark, sf_dir, "documents"))
