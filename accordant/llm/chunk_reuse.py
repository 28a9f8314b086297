r"""BPE encoding with reuse of content-defined chunks, and decoding.

A rolling hash over the last ``WINDOW`` characters tells where a text is cut,
so texts that share a passage share the chunks inside it wherever it stands.
Each chunk that lies in several parts of the corpus is encoded once, by the
part that owns it, and its ids are sent to the other parts; chunks of one part
alone are encoded there, once too. Texts stay where they were written: only
hashes of chunks and the ids of shared ones are shuffled.

A cut may fall inside a word, so chunks' ids can't just be put together. Each
join is repaired: the words around it are encoded again as one stretch, which
widens until its first and last words have just the ids that the chunks have
for them; at the latest when it is the whole text. The tokenizer drops white
space and no token has characters from both sides of it, so such words are a
place where both encodings agree from there on.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from accordant.llm.common import bound_batches, filesystem, slices, table, workspace, written
from accordant.llm.token_store import Encoder, default_tokenizer

#: Characters that the rolling hash sees (a power of two), and the bits of it that must be zero at a cut.
WINDOW, BITS = 32, 9
#: Shortest and longest chunk, in characters; the last one of a text may be shorter.
LEAST, MOST = 64, 16_384
#: Characters of a part of the corpus: what a task holds of others' ids is at most those of one part.
PART_CHARS = 1 << 24
#: Ids of chunks of its own part that a worker remembers at most, in bytes; the memory is then emptied.
REMEMBERED_BYTES = 64 << 20
#: Characters around a join of which the words are encoded again at first.
REACH = 24
#: An odd factor for the hash (from the golden ratio, a fixed value).
FACTOR = 0x9E3779B97F4A7C15

Encoded = tuple[bytes, int, int]


def candidates(texts: list[str]) -> list[np.ndarray]:
    """Places in each text where the hash of the window before them says to cut."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    h = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) * np.uint64(FACTOR)
    n, power = 1, FACTOR
    while n < WINDOW and n < len(h):
        # The hash of 2n characters is that of the last n and, times a power, that of the n before.
        h[n:] = h[n:] + h[:-n] * np.uint64(power)
        n, power = 2 * n, power * power & 0xFFFFFFFFFFFFFFFF
    at = np.flatnonzero((h * np.uint64(FACTOR)) >> np.uint64(64 - BITS) == 0) + 1
    starts = np.cumsum(sizes) - sizes
    low, high = np.searchsorted(at, starts + WINDOW), np.searchsorted(at, starts + sizes)
    return [at[a:b] - s for a, b, s in zip(low.tolist(), high.tolist(), starts.tolist(), strict=True)]


def chunk_ends(texts: list[str]) -> list[list[int]]:
    """Where each text's chunks end; an empty text has none."""
    out = []
    for text, places in zip(texts, candidates(texts), strict=True):
        ends, last = [], 0
        for p in [*places.tolist(), len(text)]:
            while p - last > MOST:
                last += MOST
                ends.append(last)
            if p - last >= LEAST or p == len(text) > last:
                last = p
                ends.append(p)
        out.append(ends)
    return out


def chunks_of(text: str, ends: list[int]) -> list[str]:
    return [text[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def cut_texts(batches: Iterator[pa.RecordBatch], part_chars: int) -> Iterator[pa.RecordBatch]:
    """To keys and text add: part, ends of chunks, hashes of chunks."""
    chars = no = 0
    for batch in slices(batches):
        texts = batch.column(batch.num_columns - 1).to_pylist()
        ends = chunk_ends(texts)
        hashes = [[hashlib.blake2b(c.encode(), digest_size=16).digest() for c in chunks_of(t, e)] for t, e in zip(texts, ends, strict=True)]
        part = pa.array([(TaskContext.get().partitionId() << 32) + no] * len(texts), pa.int64())
        lists = [pa.array(ends, pa.list_(pa.int32())), pa.array(hashes, pa.list_(pa.binary()))]
        yield pa.RecordBatch.from_arrays([*batch.columns, part, *lists], [*batch.schema.names, "part", "ends", "hashes"])
        chars += sum(map(len, texts))
        if chars >= part_chars:
            chars, no = 0, no + 1


def blank(text: str, low: int, high: int, last: bool = False) -> int:
    """The first, or last, space or line end in a stretch; -1 if it has none."""
    if last:
        space = text.rfind(" ", low, high)
        return max(space, text.rfind("\n", max(low, space), high))
    space = text.find(" ", low, high)
    line = text.find("\n", low, high if space < 0 else space)
    return line if line >= 0 else space


class ChunkEncoder:
    """Ids of chunks, and their repair."""

    def __init__(self, path: str):
        self.words = Encoder(path, "<u4")
        self.whole = self.words.whole
        size = self.whole.get_vocab_size(with_added_tokens=True)
        self.decimals = [str(i) for i in range(size)]
        self.tokens = [self.whole.id_to_token(i) for i in range(size)] if self.whole.decoder is None else None

    def plain(self, texts: list[str]) -> list[bytes]:
        return [x[:-4] for x in self.words.encode(texts)]

    def encoded(self, chunks: list[str]) -> list[Encoded]:
        """Ids of each chunk, and bytes of its ids before its first blank and after its last one."""
        heads = [c[: max(0, blank(c, 0, len(c)))] for c in chunks]
        tails = [c[blank(c, 0, len(c), last=True) + 1 :] for c in chunks]
        ids = self.plain([*chunks, *heads, *tails])
        n = len(chunks)
        return [(x, len(h), len(t)) for x, h, t in zip(ids[:n], ids[n : 2 * n], ids[2 * n :], strict=True)]

    def _bytes(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def repaired(self, text: str, low: int, high: int) -> tuple[bytes, bool]:
        """Ids of text[low:high], a stretch between blanks or the text's ends; or those of the whole text, if nothing less agrees."""
        reach = REACH
        while True:
            # Whole words within reach on either side, or the text's ends.
            low_end, high_end = max(0, low - 1 - reach), min(len(text), high + 1 + reach)
            left = (blank(text, low_end, low - 1) + 1 or low - 1) if low_end else 0
            right = blank(text, high + 1, high_end, last=True) if high_end < len(text) else len(text)
            right = high + 1 if right < 0 else right
            before, after = self.plain([text[left:low], text[high:right]])
            both = self._bytes(text[left:right])
            if len(both) >= len(before) + len(after) and both.startswith(before) and both.endswith(after):
                return both[len(before) : len(both) - len(after)], False
            if left == 0 and right == len(text):
                return both, True
            reach *= 4

    def joined(self, text: str, ends: list[int], found: list[Encoded]) -> bytes:
        """A text's ids from those of its chunks."""
        if len(ends) == 1:
            return found[0][0]
        out, start = [], 0
        for a, b, (ids, head, tail) in zip([0, *ends], ends, found, strict=False):
            first = blank(text, a, b)
            if first < 0:
                continue
            # What was open before this chunk ends at its first blank; its own last word stays open.
            if start == a:
                out.append(ids[:head])
            else:
                fixed, all_of_it = self.repaired(text, start, first)
                if all_of_it:
                    return fixed
                out.append(fixed)
            last = b == len(text)
            out.append(ids[head:] if last else ids[head : len(ids) - tail])
            start = b if last else blank(text, a, b, last=True) + 1
        if start < len(text):
            fixed, all_of_it = self.repaired(text, start, len(text))
            if all_of_it:
                return fixed
            out.append(fixed)
        return b"".join(out)

    def digests(self, ids: bytes) -> tuple[int, str, str]:
        """n_tokens, and digests of the decimal ids and of the decoded text."""
        numbers = np.frombuffer(ids, "<u4").tolist()
        said = " ".join(map(self.decimals.__getitem__, numbers))
        if self.tokens is None:
            text = self.whole.decode(numbers, skip_special_tokens=False)
        else:
            text = " ".join(map(self.tokens.__getitem__, numbers))
        return len(numbers), hashlib.sha256(said.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()


@functools.lru_cache(maxsize=1)
def encoder(path: str) -> ChunkEncoder:
    """One a Python worker; the tokenizer file is on every worker, as the library that it comes with is."""
    return ChunkEncoder(path)


def by_part(rows: DataFrame, name: str) -> str:
    """Write rows (part, ...) so that a part's own are one folder, which the tasks of that part read; that folder's parent."""
    folder = workspace(rows.sparkSession, name)
    rows.repartition("part").write.partitionBy("part").option("compression", "zstd").parquet(folder)
    return folder


def of_part(folder: str, part: int) -> pa.Table | None:
    """What ``by_part`` wrote for a part."""
    fs, path = filesystem(f"{folder}/part={part}")
    if fs.get_file_info(path).type != pafs.FileType.Directory:
        return None
    return pq.read_table(path, filesystem=fs, partitioning=None)


def owned(batches: Iterator[pa.RecordBatch], path: str, asks: str) -> Iterator[pa.RecordBatch]:
    """Rows (text, part, ends, hashes): each chunk that the part is asked for, encoded once."""
    now, asked = None, set()
    for batch in slices(batches):
        wanted = {}
        texts, parts, ends, hashes = (c.to_pylist() for c in batch.columns)
        for text, part, stops, names in zip(texts, parts, ends, hashes, strict=True):
            if part != now:
                told = of_part(asks, part)
                now, asked = part, set(told.column("hash").to_pylist()) if told is not None else set()
            if asked.isdisjoint(names):
                continue
            for name, chunk in zip(names, chunks_of(text, stops), strict=True):
                if name in asked:
                    asked.discard(name)
                    wanted[name] = chunk
        ids, heads, tails = zip(*encoder(path).encoded(list(wanted.values())), strict=True) if wanted else ((), (), ())
        columns = [pa.array(list(wanted), pa.binary()), pa.array(ids, pa.binary()), pa.array(heads, pa.int32()), pa.array(tails, pa.int32())]
        yield pa.RecordBatch.from_arrays(columns, ["hash", "ids", "head", "tail"])


def assembled(batches: Iterator[pa.RecordBatch], path: str, answers: str, digest: bool) -> Iterator[pa.RecordBatch]:
    """Rows (keys, text, part, ends, hashes): keys and ids, or their digests."""
    tools, now, shared, own, size = encoder(path), None, {}, {}, 0
    for batch in slices(batches):
        keys = batch.num_columns - 4
        texts, parts, ends, hashes = (batch.column(keys + i).to_pylist() for i in range(4))
        out = []
        if size > REMEMBERED_BYTES:
            own, size = {}, 0
        # Documents of one part together: a part's rows lie one after another.
        edges = [0, *(i for i in range(1, len(parts)) if parts[i] != parts[i - 1]), len(parts)]
        for a, b in zip(edges, edges[1:], strict=False):
            if a == b:
                continue
            if parts[a] != now:
                told, now, own, size = of_part(answers, parts[a]), parts[a], {}, 0
                columns = [c.to_pylist() for c in told.select(["hash", "ids", "head", "tail"]).columns] if told is not None else [[]] * 4
                shared = {name: told for name, *told in zip(*columns, strict=True)}
            new = {}
            for text, stops, names in zip(texts[a:b], ends[a:b], hashes[a:b], strict=True):
                for name, chunk in zip(names, chunks_of(text, stops), strict=True):
                    if name not in shared and name not in own:
                        new[name] = chunk
            for name, told in zip(new, tools.encoded(list(new.values())), strict=True):
                own[name] = told
                size += len(told[0])
            for text, stops, names in zip(texts[a:b], ends[a:b], hashes[a:b], strict=True):
                out.append(tools.joined(text, stops, [shared[n] if n in shared else own[n] for n in names]) if names else b"")
        head, names = batch.columns[:keys], batch.schema.names[:keys]
        if digest:
            told = list(zip(*map(tools.digests, out), strict=True)) or [(), (), ()]
            columns = [pa.array(told[0], pa.int64()), pa.array(told[1], pa.string()), pa.array(told[2], pa.string())]
            yield pa.RecordBatch.from_arrays([*head, *columns], [*names, "n_tokens", "ids_sha256", "decoded_sha256"])
        else:
            yield pa.RecordBatch.from_arrays([*head, pa.array(out, pa.binary())], [*names, "ids"])


def encode(
    docs: DataFrame,
    key: list[str],
    text: str = "text",
    tokenizer_path: str | None = None,
    digest: bool = False,
    part_chars: int = PART_CHARS,
) -> DataFrame:
    """Encode whole texts: key columns and ``ids`` (little-endian unsigned 32-bit integers), a row per row.

    With ``digest``, n_tokens, ids_sha256 and decoded_sha256 in place of ids. A
    null text counts as empty and has no ids. Nulls and repeats in the key are
    kept; other columns are left out, so they can't clash. An empty table gives
    no rows. The tokenizer must be one that drops white space after splitting
    there; others raise ValueError, as their joins couldn't be repaired.
    """
    bound_batches(docs.sparkSession)
    path = tokenizer_path or default_tokenizer()
    if not Encoder(path, "<u4").splits:
        raise ValueError("the tokenizer's rules for white space aren't known")
    own = [f"_k{i}" for i in range(len(key))]
    named = (F.col(k).alias(o) for k, o in zip(key, own, strict=True))
    rows = docs.select(*named, F.coalesce(F.col(text), F.lit("")).alias("text"))
    head = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema if f.name != "text")
    ddl = f"{head}text string, part bigint, ends array<int>, hashes array<binary>"
    cut = written(rows.mapInArrow(lambda b: cut_texts(b, part_chars), ddl), "chunked-texts")
    # A part's own chunks once each: a chunk of every document is a row a part and not one a document.
    where = cut.select("part", F.explode("hashes").alias("hash")).distinct()
    owner = where.groupBy("hash").agg(F.min("part").alias("part"), F.max("part").alias("other")).filter("part < other")
    asks = by_part(owner.select("part", "hash"), "chunk-asks")
    told = cut.select("text", "part", "ends", "hashes").mapInArrow(lambda b: owned(b, path, asks), "hash binary, ids binary, head int, tail int")
    # A part that is read in two tasks may have answered twice; both answers are the same.
    once = told.groupBy("hash").agg(F.first("ids").alias("ids"), F.first("head").alias("head"), F.first("tail").alias("tail"))
    answers = by_part(where.join(once, "hash"), "chunk-answers")
    result = "n_tokens bigint, ids_sha256 string, decoded_sha256 string" if digest else "ids binary"
    out = cut.mapInArrow(lambda b: assembled(b, path, answers, digest), head + result)
    return out.withColumnsRenamed(dict(zip(own, key, strict=True)))


def op12_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), ["doc_id"], digest=True)
