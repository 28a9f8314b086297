r"""Alignment of two tokenizers by the bytes of their tokens, with corpus-wide counts of linked ids.

Both tokenizers see a space and the text. Ends of tokens are cumulative sums
of their bytes; ends that both have (``intersect1d``) cut the tokens into
groups, whose labels ``searchsorted`` tells; tokens that end together are
linked, by expansion with ``repeat``.

A text is aligned in parts. At a space after a character that is no white
space both tokenizers begin a token: the pattern of A takes a space only as
the first character of a match, and no piece of B has a space after another
character. So a text's groups are those of its parts, one after another, and
what a part gives is remembered, in bounded memory. A stretch without such a
space is one part.

Counts: a task deals its documents into blocks of about ``BLOCK_LINKS`` links
and writes each document's links as places in its block's list of distinct
pairs. Only these lists are summed over the corpus, in two stages with salts,
and each block gets the counts of its own pairs back. So a pair that every
document has is a row a block, not a row a link.
"""

from __future__ import annotations

import functools
import gc
import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from accordant.llm.common import bound_batches, slices, table, written

#: Links of a block of documents; a longer document is a block of its own.
BLOCK_LINKS = 1 << 20
#: Pairs of a block that are one row.
TOGETHER = 8_192
SALTS = 16
#: Parts that a worker remembers at most (the memory is then emptied), and their longest.
REMEMBERED, SHORT = 500_000, 48
#: Characters of a long text that are cut into parts at once.
SLICE_CHARS = 1 << 18
#: Where a text may be cut: before a space that follows no white space and isn't the last character.
CUT = re.compile(r"(?<=\S) (?!\Z)")


def default_tokenizers() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


#: What a part of a text gives: its figures, its groups as text, and its links as ids of A times 2^16 plus ids of B.
Part = tuple[int, str, bytes]


def packed(n_a: int, n_b: int, n_groups: int) -> int:
    """Three figures as one number, so that one sum adds them all."""
    return n_a | n_b << 40 | n_groups << 80


def unpacked(figures: int) -> tuple[int, int, int]:
    low = (1 << 40) - 1
    return figures & low, figures >> 40 & low, figures >> 80


def expanded(ends_a: np.ndarray, ends_b: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (i, j) of tokens with ``ends_a[i] == ends_b[j]``, a common end; several tokens of one end would all be paired."""
    first_a, first_b = np.searchsorted(ends_a, common), np.searchsorted(ends_b, common)
    n_a, n_b = np.searchsorted(ends_a, common, "right") - first_a, np.searchsorted(ends_b, common, "right") - first_b
    n = n_a * n_b
    nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    wide = np.repeat(n_b, n)
    return np.repeat(first_a, n) + nth // wide, np.repeat(first_b, n) + nth % wide


class Aligner:
    """Two tokenizers and what they gave for parts that came before."""

    def __init__(self, path_a: str, path_b: str):
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        # Byte-level letters: printable bytes stand for themselves, the others for letters from 256 on (fixed by the file format).
        own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        others = [b for b in range(256) if b not in set(own)]
        byte_of = {chr(b): b for b in own} | {chr(256 + n): b for n, b in enumerate(others)}
        vocabulary = self.a.get_vocab(with_added_tokens=False)
        n_a, n_b = max(vocabulary.values()) + 1, self.b.get_piece_size()
        if n_b > 1 << 16 or n_a > 1 << 16:
            raise ValueError("links hold ids of 16 bits")
        self.bytes_a = [b""] * n_a
        for token, i in vocabulary.items():
            self.bytes_a[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
        self.bytes_b = [self._piece(i) for i in range(n_b)]
        self.size_a, self.size_b = (np.fromiter(map(len, t), np.int64, len(t)) for t in (self.bytes_a, self.bytes_b))
        self.no_empty_token = bool(self.size_a.all() and self.size_b.all())
        # Decimal ids with what follows them: a comma, or the end of a group's A or B ids.
        self.said = [f"{i}{mark}" for n, mark in ((n_a, ","), (n_a, "|"), (n_b, ","), (n_b, ";")) for i in range(n)]
        self.said_size = np.fromiter(map(len, self.said), np.int64, len(self.said))
        self.known: dict[str, Part | None] = {}
        self.long: list[str] = []

    def _piece(self, i: int) -> bytes:
        if self.b.is_byte(i):
            return bytes([int(self.b.id_to_piece(i)[3:-1], 16)])
        return self.b.id_to_piece(i).replace("▁", " ").encode()

    def _faithful(self, ids: list[list[int]], table: list[bytes], spaced: list[bytes]) -> list[bool]:
        """Whether the joined bytes of each part's tokens are the part's."""
        flat = b"".join([table[i] for i in chain.from_iterable(ids)])
        sizes = self.size_a if table is self.bytes_a else self.size_b
        own = [int(sizes[x].sum()) for x in ids] if flat != b"".join(spaced) else None
        if own is None:
            # Equal as a whole; part by part too, if each has a space before it and its own length.
            ends = np.cumsum(sizes[np.fromiter(chain.from_iterable(ids), np.int64)])
            n = np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)))
            if n[0] > 0 and np.array_equal(ends[n - 1], np.cumsum(np.fromiter(map(len, spaced), np.int64, len(spaced)))):
                return [True] * len(ids)
        return [b"".join([table[i] for i in x]) == w for x, w in zip(ids, spaced, strict=True)]

    def aligned(self, parts: list[str]) -> list[Part | None]:
        """Each part's alignment; None where joined bytes of either tokenizer aren't a space and the part."""
        spaced = [" " + p for p in parts]
        raw = [x.encode() for x in spaced]
        ids_a = [e.ids for e in self.a.encode_batch_fast(spaced, add_special_tokens=False)]
        ids_b = self.b.encode(parts, num_threads=1)
        whole = [x and y for x, y in zip(self._faithful(ids_a, self.bytes_a, raw), self._faithful(ids_b, self.bytes_b, raw), strict=True)]
        good = [n for n, ok in enumerate(whole) if ok]
        out: list[Part | None] = [None] * len(parts)
        if not good:
            return out
        ids_a, ids_b = [ids_a[n] for n in good], [ids_b[n] for n in good]
        n_a, n_b = (np.fromiter(map(len, x), np.int64, len(good)) for x in (ids_a, ids_b))
        a, b = (np.fromiter(chain.from_iterable(x), np.int64, k.sum()) for x, k in ((ids_a, n_a), (ids_b, n_b)))
        ends_a, ends_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        common = np.intersect1d(ends_a, ends_b, assume_unique=self.no_empty_token)
        group_a, group_b = np.searchsorted(common, ends_a), np.searchsorted(common, ends_b)
        i, j = expanded(ends_a, ends_b, common)
        links = (a[i] << 16 | b[j]).astype("<u4").tobytes()
        # Ids in the order of groups, those of A before those of B.
        order = np.empty(len(a) + len(b), np.int64)
        last_a, last_b = (np.append(g[1:] != g[:-1], True) for g in (group_a, group_b))
        place_a = np.arange(len(a)) + np.searchsorted(group_b, group_a)
        place_b = np.arange(len(b)) + np.searchsorted(group_a, group_b, "right")
        order[place_a] = a + len(self.bytes_a) * last_a
        order[place_b] = 2 * len(self.bytes_a) + b + len(self.bytes_b) * last_b
        said = "".join(map(self.said.__getitem__, order.tolist()))
        # Where each part ends: in tokens, characters, groups and links.
        to_a, to_b = np.cumsum(n_a), np.cumsum(n_b)
        to_char = np.cumsum(self.said_size[order])[to_a + to_b - 1]
        to_group = group_a[to_a - 1] + 1
        to_link = 4 * np.searchsorted(i, to_a)
        told = zip(good, *(x.tolist() for x in (n_a, n_b, to_char, to_group, to_link)), strict=True)
        char = group = link = 0
        for n, x, y, c, g, k in told:
            out[n] = (packed(x, y, g - group), said[char : c - 1], links[link:k])
            char, group, link = c, g, k
        return out

    def learn(self, lists: list[list[str]]) -> None:
        """Align what of these lists of parts isn't known."""
        new = list(set(chain.from_iterable(lists)).difference(self.known))
        if new:
            self.known.update(zip(new, self.aligned(new), strict=True))
            self.long.extend(p for p in new if len(p) > SHORT)

    def forget(self) -> None:
        """Keep short parts only, and none once there are too many; called between documents."""
        for p in self.long:
            self.known.pop(p, None)
        self.long.clear()
        if len(self.known) > REMEMBERED:
            self.known.clear()


def slices_of(text: str, slice_chars: int) -> Iterator[list[str]]:
    """A text's parts, so many characters of it at once."""
    start = 0
    while start < len(text):
        end = len(text)
        if end - start > slice_chars:
            found = CUT.search(text, start + slice_chars)
            end = found.start() if found else end
        yield CUT.split(text[start:end])
        start = end + 1


class Aligned:
    """A document's figures, its links as codes of pairs, and the digest of its groups."""

    def __init__(self) -> None:
        self.figures, self.links, self.sha, self.empty, self.good = 0, [], hashlib.sha256(), True, True

    def add(self, found: list[Part | None]) -> None:
        """Alignments of the next parts."""
        if not self.good or None in found:
            self.good, self.links = False, []
            return
        figures, groups, links = zip(*found, strict=True)
        self.figures += sum(figures)
        self.sha.update((";" if not self.empty else "").encode() + ";".join(groups).encode())
        self.links.append(b"".join(links))
        self.empty = False

    def told(self) -> tuple[int, int, int, str, bytes]:
        if self.empty or not self.good:
            return 0, 0, 0, "", b""
        return *unpacked(self.figures), self.sha.hexdigest(), b"".join(self.links)


def align(text: str, tools: Aligner, slice_chars: int = SLICE_CHARS) -> tuple[int, int, int, str, bytes]:
    """n_a, n_b, n_groups, the digest of the groups, and the links of a text."""
    out = Aligned()
    for parts in slices_of(text, slice_chars):
        tools.learn([parts])
        out.add([tools.known[p] for p in parts])
        tools.forget()
    return out.told()


@functools.lru_cache(maxsize=1)
def aligner(path_a: str, path_b: str) -> Aligner:
    """One a Python worker; tokenizer files are on every worker, as the library that they come with is."""
    return Aligner(path_a, path_b)


#: Columns of what a task writes: documents (pairs null) and lists of their block's pairs (key null).
FIGURES = [("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string())]
FIGURES_DDL = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string"


def blocks(batches: Iterator[pa.RecordBatch], path_a: str, path_b: str, block_links: int, slice_chars: int) -> Iterator[pa.RecordBatch]:
    """Align documents (key, text) and deal them into blocks."""
    # What is remembered is tuples of numbers and strings: walks of the cyclic collector over them would find nothing.
    gc.disable()
    tools, no, held, size, key_type = aligner(path_a, path_b), 0, [], 0, None

    def told() -> Iterator[pa.RecordBatch]:
        nonlocal no, held, size
        block = (TaskContext.get().partitionId() << 32) + no
        every = np.frombuffer(b"".join([x[-1] for x in held]), "<u4")
        codes, place, times = np.unique(every, return_inverse=True, return_counts=True)
        raw, at = place.astype("<u4").tobytes(), 0
        rows = []
        for key, n_a, n_b, n_groups, sha, links in held:
            n = len(links)
            rows.append((key, n_a, n_b, n_groups, n // 4, sha, raw[at : at + n]))
            at += n
        n = len(held)
        types = [key_type, *(t for _, t in FIGURES), pa.binary()]
        documents = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)]
        lists = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        names = ["block", "key", *(x for x, _ in FIGURES), "places", "first", "codes", "times"]
        nothing = [pa.nulls(n, t) for t in lists]
        yield pa.RecordBatch.from_arrays([pa.array([block] * n, pa.int64()), *documents, *nothing], names)
        for first in range(0, len(codes), TOGETHER):
            some = slice(first, first + TOGETHER)
            pairs = [pa.array([first], lists[0]), *(pa.array([x[some].tolist()], lists[1]) for x in (codes, times))]
            none = [pa.nulls(1, t) for t in types]
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), *none, *pairs], names)
        no, held, size = no + 1, [], 0

    for batch in slices(batches):
        key_type = batch.schema.field(0).type
        texts = [x or "" for x in batch.column(1).to_pylist()]
        # New parts of many texts go to the tokenizers together; a long text goes in slices of its own.
        cut = [CUT.split(x) if 0 < len(x) <= slice_chars else [] for x in texts]
        tools.learn(cut)
        known = tools.known
        told_of = []
        for parts in cut:
            out = Aligned()
            if parts:
                out.add([known[p] for p in parts])
            told_of.append(out.told())
        tools.forget()
        for key, text, figures in zip(batch.column(0).to_pylist(), texts, told_of, strict=True):
            held.append((key, *(figures if len(text) <= slice_chars else align(text, tools, slice_chars))))
            size += len(held[-1][-1]) // 4
            if size >= block_links:
                yield from told()
    if held:
        yield from told()


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of blocks, each block's counts before its documents: the documents with n_best and count_sum."""
    block, values, counts, best = None, [], np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        of, value = batch.column("block").to_numpy(), batch.column("value").to_pylist()
        edges = [0, *(np.flatnonzero(of[1:] != of[:-1]) + 1).tolist(), len(of)]
        n_best, count_sum = [], []
        for a, b in zip(edges, edges[1:], strict=False):
            if a == b:
                continue
            if of[a] != block:
                block, values, counts = of[a], [], None
            documents = a
            while documents < b and value[documents] is not None:
                documents += 1
            values.extend(value[a:documents])
            if documents < b and (counts is None or documents > a):
                both = np.array(values, np.int64)
                counts, best = both >> 1, both & 1
            for places in batch.column("places").slice(documents, b - documents).to_pylist():
                at = np.frombuffer(places, "<u4")
                n_best.append(int(best[at].sum()))
                count_sum.append(int(counts[at].sum()))
        out = batch.filter(batch.column("value").is_null())
        columns = [out.column(n) for n in ("key", "n_a", "n_b", "n_groups", "n_links")]
        sums = [pa.array(n_best, pa.int64()), pa.array(count_sum, pa.int64())]
        names = ["key", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
        yield pa.RecordBatch.from_arrays([*columns, *sums, out.column("groups_sha256")], names)


def pair_counts(dealt: DataFrame, salts: int = SALTS) -> DataFrame:
    """(code, n): how many links of the corpus hold each pair of ids, summed by (pair, salt) and then by pair."""
    pairs = dealt.filter("codes IS NOT NULL").select("block", F.explode(F.arrays_zip("codes", "times")).alias("p"))
    salted = pairs.select("p.codes", "p.times", F.pmod(F.xxhash64("block"), F.lit(salts)).alias("salt"))
    once = salted.groupBy(F.col("codes").alias("code"), "salt").agg(F.sum("times").alias("n"))
    return once.groupBy("code").agg(F.sum("n").alias("n"))


def link_figures(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    tokenizers: tuple[str, str] | None = None,
    block_links: int = BLOCK_LINKS,
    slice_chars: int = SLICE_CHARS,
) -> DataFrame:
    """A row per row: key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Texts that are null or empty, or whose joined bytes aren't a space and the
    text, have no tokens: zeros and ''. Keys may be null or repeated, each row
    is one document. Other columns are left out and can't clash. An empty
    table gives no rows.
    """
    bound_batches(docs.sparkSession)
    path_a, path_b = tokenizers or default_tokenizers()
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    ddl = f"block bigint, key {kind}, {FIGURES_DDL}, places binary, first bigint, codes array<bigint>, times array<bigint>"
    dealt = written(rows.mapInArrow(lambda b: blocks(b, path_a, path_b, block_links, slice_chars), ddl), "aligned")
    sums = written(pair_counts(dealt), "pair-counts")
    of_b = F.col("code").bitwiseAND(F.lit(0xFFFF))
    most = sums.groupBy(of_b.alias("b")).agg(F.max("n").alias("most"))
    # A row an id of B: bounded by its vocabulary, at any input size.
    told = sums.join(F.broadcast(most), of_b == F.col("b")).select("code", (F.col("n") * 2 + (F.col("n") == F.col("most")).cast("int")).alias("value"))
    asked = dealt.filter("codes IS NOT NULL").select("block", "first", F.posexplode("codes").alias("nth", "code"))
    answers = asked.join(told, "code").select("block", (F.col("first") + F.col("nth")).alias("place"), "value")
    documents = dealt.filter("codes IS NULL").drop("first", "codes", "times")
    both = documents.unionByName(answers, allowMissingColumns=True)
    dealt_again = both.repartition("block").sortWithinPartitions("block", F.col("place").asc_nulls_last())
    out = dealt_again.mapInArrow(
        counted, f"key {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"
    )
    return out.withColumnRenamed("key", key)


def op13_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_figures(table(spark, sf_dir, "documents"))
