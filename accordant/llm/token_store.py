"""Token ids as binary shard files with a minimal perfect hash index.

A shard file holds the raw ids of its documents in ascending id order, then an
index: a minimal perfect hash from document key to rank, and at each rank a
stored fingerprint of the key, the place of the key's first record, and how
many records it has. A lookup hashes the key, compares the fingerprint and
reads one byte range: constant time, whatever the shard holds.

File: magic, the sections ids, lengths, keys, mphf words, mphf ranks,
fingerprints, firsts and repeats, then a JSON line (dtype, counts, byte lengths
of the sections), its length and the magic again. Ids go to the file as they
come; a task holds keys and lengths of one shard, and begins another after
``SHARD_BYTES`` of ids. Which shard has which key is a table, and so are the
shards' sizes; reading joins the two and goes through each shard's index.
"""

from __future__ import annotations

import functools
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer, pre_tokenizers

from accordant.llm.common import SLICE_ROWS, filesystem, slices, table, workspace, written

MAGIC = b"ACCTOK1\n"
END_ID = 1
#: Bytes of ids after which a task begins another shard, and that are read at once.
SHARD_BYTES, READ_BYTES = 64 << 20, 4 << 20
#: Distinct words whose ids a worker remembers at most; those that came only once are then forgotten.
REMEMBERED_WORDS = 500_000
#: Bits of a level of the hash for each key that is left.
GAMMA = 2
#: The key of records without one: they have shards of their own, so it is nobody else's.
NO_KEY = 0


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser over integer keys (constants of SplitMix64, fixed values)."""
    z = keys.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


@dataclass
class MinimalPerfectHash:
    """Levels of bit arrays: a key's rank is the set bits before its own, which is the first level's bit that it alone hits."""

    levels: list[int]  # bits in each level
    words: np.ndarray  # all levels' bits, each level begins a word
    ranks: np.ndarray  # set bits before each word

    @classmethod
    def build(cls, keys: np.ndarray) -> MinimalPerfectHash:
        """Keys must be distinct."""
        left, levels, parts = keys, [], []
        while len(left):
            bits = -(-max(64, GAMMA * len(left)) // 64) * 64
            at = mixed(left, len(levels)) % np.uint64(bits)
            hits = np.bincount(at.astype(np.int64), minlength=bits)
            parts.append(np.packbits(hits == 1, bitorder="little").view("<u8"))
            levels.append(bits)
            left = left[hits[at.astype(np.int64)] > 1]
        words = np.concatenate(parts) if parts else np.zeros(0, "<u8")
        ranks = np.concatenate(([0], np.cumsum(np.bitwise_count(words).astype(np.int64))[:-1])) if len(words) else np.zeros(0, np.int64)
        return cls(levels, words, ranks)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """Ranks; -1 where no level has the key's bit. Keys that weren't built in may get any rank."""
        out, left, base = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
        for level, bits in enumerate(self.levels):
            at = mixed(keys[left], level) % np.uint64(bits)
            word, bit = base + (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            hit = (self.words[word] >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(self.words[word[hit]] & ((np.uint64(1) << bit[hit]) - np.uint64(1))).astype(np.int64)
            out[left[hit]] = self.ranks[word[hit]] + below
            left, base = left[~hit], base + bits // 64
        return out


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mixed(keys, 1_000) >> np.uint64(32)).astype("<u4")


SECTIONS = (
    ("ids", None), ("lengths", "<u4"), ("keys", "<i8"), ("words", "<u8"),
    ("ranks", "<i8"), ("fingerprints", "<u4"), ("firsts", "<i8"), ("repeats", "<u4"),
)


class ShardWriter:
    """A shard file that is written record by record, under a name of its own until it is whole.

    Keys ascend; the records of a repeated key lie together. Records without a
    key have shards of their own (``keyless``).
    """

    def __init__(self, uri: str, dtype: str, keyless: bool = False):
        self.dtype, self.width, self.keyless = dtype, np.dtype(dtype).itemsize, keyless
        self.fs, self.path = filesystem(uri)
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.own = f"{self.path}.{uuid.uuid4().hex}.tmp"
        self.out = self.fs.open_output_stream(self.own)
        self.out.write(MAGIC)
        self.keys: list[int] = []
        self.lengths: list[int] = []
        self.size = 0

    def add(self, key: int, ids: bytes) -> None:
        self.out.write(ids)
        self.keys.append(key)
        self.lengths.append(len(ids) // self.width)
        self.size += len(ids)

    def close(self) -> np.ndarray:
        """Write the index and name the file; its distinct keys."""
        distinct, first, repeats = np.unique(np.array(self.keys, np.int64), return_index=True, return_counts=True)
        mph = MinimalPerfectHash.build(distinct)
        place = np.empty(len(distinct), np.int64)
        place[mph(distinct)] = np.arange(len(distinct))
        parts = {
            "lengths": self.lengths, "keys": self.keys, "words": mph.words, "ranks": mph.ranks,
            "fingerprints": fingerprints(distinct)[place], "firsts": first[place], "repeats": repeats[place],
        }
        raw = {name: np.ascontiguousarray(parts[name], kind).tobytes() for name, kind in SECTIONS if kind}
        sizes = {"ids": self.size} | {k: len(v) for k, v in raw.items()}
        head = {"dtype": self.dtype, "documents": len(self.keys), "levels": mph.levels, "bytes": sizes, "keyless": self.keyless}
        line = json.dumps(head).encode() + b"\n"
        for name, kind in SECTIONS:
            if kind:
                self.out.write(raw[name])
        self.out.write(line + len(line).to_bytes(8, "little") + MAGIC)
        self.out.close()
        self.fs.move(self.own, self.path)
        return distinct


class Shard:
    """A shard file opened for keyed reads; only the index is held in memory."""

    def __init__(self, uri: str):
        fs, path = filesystem(uri)
        self.uri, self.file = uri, fs.open_input_file(path)
        end = self.file.size()
        tail = len(MAGIC) + 8
        if end < len(MAGIC) + tail or self._read(end - len(MAGIC), len(MAGIC)) != MAGIC or self._read(0, len(MAGIC)) != MAGIC:
            raise ValueError(f"{uri} is no token shard")
        size = int.from_bytes(self._read(end - tail, 8), "little")
        self.head = json.loads(self._read(end - tail - size, size))
        at = self.ids_at = len(MAGIC)
        for name, kind in SECTIONS:
            n = self.head["bytes"][name]
            if kind:
                setattr(self, name, np.frombuffer(self._read(at, n), kind))
            at += n
        self.width = np.dtype(self.head["dtype"]).itemsize
        self.offsets = np.concatenate(([0], np.cumsum(self.lengths.astype(np.int64))))
        self.mph = MinimalPerfectHash(self.head["levels"], self.words, self.ranks)

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """By the hash and the stored fingerprints: each key's first record, and how many it has (0 if the shard hasn't the key)."""
        rank = self.mph(keys)
        found = np.flatnonzero(rank >= 0)
        found = found[self.fingerprints[rank[found]] == fingerprints(keys[found])]
        found = found[self.keys[self.firsts[rank[found]]] == keys[found]]
        first, repeats = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        first[found], repeats[found] = self.firsts[rank[found]], self.repeats[rank[found]]
        return first, repeats

    def records(self, numbers: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(tokens before it in the shard, ids) of records by number; such as lie together are read together, a bounded part at a time."""
        at, ends = self.offsets[numbers], self.offsets[numbers + 1]
        cut = 0
        while cut < len(numbers):
            stop = cut + 1
            while stop < len(numbers) and at[stop] == ends[stop - 1] and (ends[stop] - at[cut]) * self.width <= READ_BYTES:
                stop += 1
            base = int(at[cut])
            raw = np.frombuffer(self._read(self.ids_at + base * self.width, int(ends[stop - 1] - base) * self.width), self.head["dtype"])
            for a, b in zip(at[cut:stop].tolist(), ends[cut:stop].tolist(), strict=True):
                yield a, raw[a - base : b - base]
            cut = stop

    def get(self, key: int) -> list[np.ndarray]:
        """Ids of each record of a key; none if the shard hasn't the key."""
        first, repeats = self.places(np.array([key], np.int64))
        return [ids for _, ids in self.records(np.arange(first[0], first[0] + repeats[0]))]


class Encoder:
    """Ids of whole texts by a tokenizer whose white space only parts words, with a memory of words.

    The tokenizer normalises a text, drops white space, splits the rest into
    pre-tokens and merges the bytes of each, so a text's ids are those of its
    parts between spaces or line ends, one after another. Parts of plain Latin
    letters, digits and marks are split here by the same rule and only new
    pre-tokens go to the library's merges, many at once: every pre-token ends
    in just one id that ends a word. Any other part goes to the whole
    tokenizer, and so do whole texts if the file's rules aren't these.
    """

    #: What a tokenizer file must have for that (fixed values).
    NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
    SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}

    #: Characters whose normal form is their own and whose lower case is one such character.
    PLAIN = re.compile("[!-~À-ÖØ-öø-įı-ſ]+")
    #: The tokenizer's own pre-tokens (a fixed value), written for these characters.
    PRE_TOKEN = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ſ]+|[0-9]|[^a-z0-9ß-öø-ſ]+")
    TOGETHER = 200
    #: Words whose ids are put together at once.
    AT_ONCE = 100_000
    #: Characters under which texts aren't worth a column.
    FEW = 4_000

    def __init__(self, path: str, dtype: str):
        self.dtype = dtype
        self.whole, self.merges = Tokenizer.from_file(path), Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            self.splits = self.is_known(json.load(f))
        self.merges.normalizer = None
        self.merges.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocabulary = self.whole.get_vocab(with_added_tokens=True)
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        # Byte-level letters: printable bytes stand for themselves, the others for letters from 256 on; blanks part words here.
        own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
        self.letters = np.arange(256, dtype="<u4")
        self.letters[[b for b in range(256) if b not in own]] = np.arange(256, 512 - len(own))
        self.letters[0x20] = 0x20
        # The memory: a word's number n, its ids, which are ids[starts[n] : starts[n + 1]], and whether it was asked for again.
        self.known: dict[str, int] = {}
        self.ids, self.starts, self.used = np.empty(1 << 12, dtype), np.zeros(1 << 10, np.int64), np.zeros(1 << 10, bool)

    @classmethod
    def is_known(cls, rules: dict) -> bool:
        """Whether a tokenizer's rules are those that texts are split by here."""
        split = {"type": "Split", "pattern": {"Regex": cls.SPLIT}, "behavior": "Removed", "invert": True}
        return (
            rules["normalizer"] == {"type": "Sequence", "normalizers": cls.NORMALIZER}
            and rules["pre_tokenizer"] == {"type": "Sequence", "pretokenizers": [split, cls.BYTES]}
            and rules["post_processor"] is None
            and rules["model"]["type"] == "BPE"
            and rules["model"]["end_of_word_suffix"] == "</w>"
            and all(t["content"].startswith("<|") and t["special"] for t in rules["added_tokens"])
        )

    def _merged(self, pre_tokens: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids of pre-tokens, one after another, and how many each one has."""
        for at in range(0, len(pre_tokens), self.TOGETHER):
            some = pre_tokens[at : at + self.TOGETHER]
            line = " ".join(some)
            if not line.isascii():
                line = self.letters[np.frombuffer(line.encode(), np.uint8)].tobytes().decode("utf-32-le")
            ids = np.array(self.merges.encode_batch_fast([line], add_special_tokens=False)[0].ids, self.dtype)
            ends = np.flatnonzero(self.ends_word[ids]) + 1
            if len(ends) == len(some):
                yield ids[: ends[-1]], np.diff(ends, prepend=0)
            else:
                yield from self._each(some)

    def _each(self, words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The same of words that go to the whole tokenizer."""
        for w in words:
            ids = np.array(self.whole.encode(w, add_special_tokens=False).ids, self.dtype)
            yield ids, np.array([len(ids)])

    def _keep(self, words: list[str], ids: np.ndarray, counts: np.ndarray) -> None:
        """Give new words the next numbers, and their ids the next places."""
        n = len(self.known)
        at, end = int(self.starts[n]), int(self.starts[n]) + len(ids)
        self.ids, self.starts, self.used = roomy(self.ids, end), roomy(self.starts, n + len(words) + 1), roomy(self.used, n + len(words))
        self.ids[at:end] = ids
        self.used[n : n + len(words)] = False
        self.starts[n + 1 : n + 1 + len(words)] = at + np.cumsum(counts)
        self.known.update(zip(words, range(n, n + len(words)), strict=True))

    def _forget(self) -> None:
        """Words that weren't asked for again go; all go if the others would leave too little room."""
        words, stay = list(self.known), np.flatnonzero(self.used[: len(self.known)])
        ids, ends = self._told(stay)
        self.known.clear()
        if len(stay) <= REMEMBERED_WORDS // 2:
            self._keep([words[i] for i in stay.tolist()], ids, np.diff(ends, prepend=0))

    def _told(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words by number, one word after another, and where each one's end."""
        parts, ends, before = [self.ids[:0]], np.empty(len(numbers), np.int64), 0
        for at in range(0, len(numbers), self.AT_ONCE):
            some = numbers[at : at + self.AT_ONCE]
            first = self.starts[some]
            counts = self.starts[some + 1] - first
            own = np.cumsum(counts)
            parts.append(self.ids[np.repeat(first - own + counts, counts) + np.arange(own[-1])])
            ends[at : at + len(some)] = before + own
            before += own[-1]
        return np.concatenate(parts), ends

    def _learn(self, new: list[str]) -> None:
        """Pre-tokens are words of the memory, too: split once more they stay as they are."""
        before, merge, whole, several = len(self.known), {}, [], {}
        for w in new:
            if w.isalpha() and (w.isascii() or self.PLAIN.fullmatch(w)):
                low = w.lower()
                merge[low] = None
                if low != w:
                    several[w] = (low,)
            elif self.PLAIN.fullmatch(w) and "<|" not in w:
                parts = self.PRE_TOKEN.findall(w.lower())
                for x in parts:
                    merge[x] = None
                if parts[0] != w:
                    several[w] = parts
            else:
                whole.append(w)
        merge = [x for x in merge if x not in self.known]
        for words, told in ((merge, self._merged(merge)), (whole, self._each(whole))):
            if words:
                self._keep(words, *map(np.concatenate, zip(*told, strict=True)))
        if several:
            numbers = np.array([self.known[x] for xs in several.values() for x in xs])
            self.used[numbers[numbers < before]] = True
            ids, ends = self._told(numbers)
            self._keep(list(several), ids, np.diff(ends[np.cumsum([len(xs) for xs in several.values()]) - 1], prepend=0))

    def _few(self, text: str) -> bytes:
        """Ids of a short text, without columns."""
        words = text.replace("\n", " ").split(" ")
        numbers = [n for w in words if (n := self.known.get(w)) is not None]
        self.used[numbers] = True
        if len(numbers) < len(words):
            self._learn([w for w in dict.fromkeys(words) if w not in self.known])
            numbers = [self.known[w] for w in words]
        raw, at, width = self.ids.view(np.uint8).data, self.starts.item, self.ids.itemsize
        return b"".join([raw[at(n) * width : at(n + 1) * width] for n in numbers])

    def encode(self, texts: list[str] | pa.Array, end_id: int = END_ID) -> list[bytes]:
        """Ids of each text and ``end_id``, as bytes. Each distinct word of the texts is looked up once."""
        if not self.splits:
            texts = texts.to_pylist() if isinstance(texts, pa.Array) else texts
            return [np.array([*e.ids, end_id], self.dtype).tobytes() for e in self.whole.encode_batch_fast(texts, add_special_tokens=False)]
        if len(self.known) > REMEMBERED_WORDS:
            self._forget()
        end = np.array([end_id], self.dtype).tobytes()
        if not isinstance(texts, pa.Array) and sum(map(len, texts)) < self.FEW:
            return [self._few(x) + end for x in texts]
        column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
        split = pc.split_pattern(pc.replace_substring(column, "\n", " "), " ")
        words = split.flatten().dictionary_encode()
        distinct = words.dictionary.to_numpy(zero_copy_only=False).tolist()
        numbers = np.array([self.known.get(w, -1) for w in distinct], np.int32)
        self.used[numbers[numbers >= 0]] = True
        if len(unknown := np.flatnonzero(numbers < 0)):
            new = [distinct[i] for i in unknown.tolist()]
            self._learn(new)
            numbers[unknown] = [self.known[w] for w in new]
        ids, ends = self._told(numbers[words.indices.to_numpy()])
        cuts = (ends[np.cumsum(pc.list_value_length(split).to_numpy()) - 1] * ids.itemsize).tolist()
        raw = ids.tobytes()
        return [raw[a:b] + end for a, b in zip([0, *cuts], cuts, strict=False)]


def roomy(array: np.ndarray, size: int) -> np.ndarray:
    """The array, or a copy of twice its size at least, that has so many places."""
    return array if size <= len(array) else np.concatenate([array, np.empty(max(size - len(array), len(array)), array.dtype)])


@functools.lru_cache(maxsize=1)
def encoder(path: str, dtype: str) -> Encoder:
    """One a Python worker."""
    return Encoder(path, dtype)


INDEX = pa.schema([("name", pa.string()), ("part", pa.int32()), ("no", pa.int32()), ("key", pa.int64()), ("tokens", pa.int64()), ("documents", pa.int64()), ("keyless", pa.bool_())])
INDEX_DDL = "name string, part int, no int, key bigint, tokens bigint, documents bigint, keyless boolean"


def write_shards(
    docs: DataFrame,
    folder: str,
    key: str = "doc_id",
    text: str = "text",
    tokenizer_path: str | None = None,
    shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """Encode documents and write shard files in ascending key order; the table of what is where, written.

    A row a shard has its ``tokens`` and ``documents``, in the order of (part,
    no); a row a key of a shard has ``key`` and neither. A null text counts as
    empty. Null keys sort first and have ``keyless`` shards. Repeated keys are
    all kept. Other columns are left out. Texts are dealt to ranges of (key,
    text's hash) and encoded where they arrive, so ids are never shuffled and a
    hot key spreads over shards. Nothing comes to the driver.
    """
    path = tokenizer_path or default_tokenizer()
    wide = max(Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True), END_ID + 1) > 65_536
    dtype = "<u4" if wide else "<u2"
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(key).cast("long").alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text")).withColumn("_h", F.xxhash64("_text"))
    ordered = rows.repartitionByRange(parts, "_key", "_h").sortWithinPartitions("_key", "_h").select("_key", "_text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, no, shard = TaskContext.get().partitionId(), 0, None

        def told() -> pa.RecordBatch:
            nonlocal no, shard
            keys = shard.close()
            n = len(keys) + 1
            none = pa.nulls(n - 1, pa.int64())
            columns = [
                pa.array([shard.path.rpartition("/")[2]] * n), pa.array([part] * n, pa.int32()), pa.array([no] * n, pa.int32()),
                pa.array([None, *keys.tolist()], pa.int64()),
                pa.concat_arrays([pa.array([shard.size // shard.width], pa.int64()), none]),
                pa.concat_arrays([pa.array([len(shard.keys)], pa.int64()), none]), pa.array([shard.keyless] * n),
            ]
            no, shard = no + 1, None
            return pa.RecordBatch.from_arrays(columns, schema=INDEX)

        for batch in slices(batches):
            for k, ids in zip(batch.column(0).to_pylist(), encoder(path, dtype).encode(batch.column(1)), strict=True):
                if shard is not None and shard.keyless != (k is None):
                    yield told()
                if shard is None:
                    shard = ShardWriter(f"{folder}/shard-{part:06d}-{no:05d}.tok", dtype, k is None)
                shard.add(NO_KEY if k is None else k, ids)
                if shard.size >= shard_bytes:
                    yield told()
        if shard is not None:
            yield told()

    return written(ordered.mapInArrow(write, INDEX_DDL), "token-index")


def read_shards(index: DataFrame, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 of every record.

    Each key of the index is looked up in its shard, through hash, fingerprint
    and place; a key that isn't found raises an error. A shard's keys come to
    one task, one after another, so that it is opened once.
    """
    before = Window.orderBy("part", "no").rowsBetween(Window.unboundedPreceding, -1)
    # One row a shard: a window without keys over these few rows is no bottleneck.
    shards = index.filter("tokens IS NOT NULL").select("name", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("base"))
    # A number of parts, as an index's own size tells nothing of what its shards hold.
    parts = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = index.filter("tokens IS NULL").select("name", "key", "keyless").repartition(parts, "name")
    wanted = keys.join(shards, "name").select("name", "base", "key", "keyless").sortWithinPartitions("name", "key")
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard: Shard | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            names, bases, keyless = (batch.column(i).to_pylist() for i in (0, 1, 3))
            keys = batch.column(2).to_numpy()
            cuts = [0, *(i for i in range(1, len(names)) if names[i] != names[i - 1]), len(names)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                uri = f"{folder}/{names[a]}"
                if shard is None or shard.uri != uri:
                    shard = Shard(uri)
                first, repeats = shard.places(keys[a:b])
                if not repeats.all():
                    raise KeyError(f"{uri} hasn't the key {keys[a:b][repeats == 0][0]}")
                numbers = np.repeat(first - np.cumsum(repeats) + repeats, repeats) + np.arange(repeats.sum())
                told = np.repeat(keys[a:b], repeats).tolist() if not keyless[a] else [None] * len(numbers)
                for at in range(0, len(numbers), SLICE_ROWS):
                    found = list(shard.records(numbers[at : at + SLICE_ROWS]))
                    columns = [
                        told[at : at + SLICE_ROWS],
                        [bases[a] + place for place, _ in found],
                        [len(ids) for _, ids in found],
                        [zlib.crc32(ids.astype("<u4").tobytes()) for _, ids in found],
                    ]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=schema)

    return wanted.mapInArrow(read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def lookup(index: DataFrame, folder: str, key: int | None) -> list[np.ndarray]:
    """Ids of each record of a key, from the one or few shards that have it."""
    k = NO_KEY if key is None else key
    shards = index.filter(F.col("tokens").isNull() & (F.col("key") == k) & (F.col("keyless") == (key is None))).orderBy("part", "no").select("name").toLocalIterator()
    return [ids for r in shards for ids in Shard(f"{folder}/{r.name}").get(k)]


def op5_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = workspace(spark, "tokens")
    return read_shards(write_shards(table(spark, sf_dir, "documents"), folder), folder)
