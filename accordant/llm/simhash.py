r"""SimHash near-duplicates: fingerprints, BK-trees over shards, and components.

Links are pairs of fingerprints that differ in at most ``RADIUS`` bits. Two
such fingerprints agree in one of four blocks of 16 bits, so fingerprints are
dealt to shards by (block, its value). A shard that holds more than
``SHARD_ROWS`` fingerprints is dealt anew by the same argument over the bits
that its members don't yet share (four blocks of 12, then of 9). What is still
larger is cut into parts of at most that size, and each pair of parts becomes
a shard. So a shard's tree has a bound, no pair is left out, and no task gets
a hot group whole.

In each shard a BK-tree is built (children keyed by their Hamming distance to
the parent); queries follow only edges whose key is within the radius of the
distance at the node. A shard gives no list of its links but a spanning forest
of them: at most one edge for each member, which keeps every link's
connection. Components are found over these edges by alternating large-star
and small-star steps, each written to the shared folder.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from accordant.llm.common import slices, table, written

RADIUS = 3
SHINGLE_WORDS = 3
SEED = 42
SHARD_ROWS = 256
#: Bits of each of four blocks at the levels of dealing: all 64, then what a shard's members don't share.
BLOCK_BITS = (16, 12, 9)
#: Hashes whose bits are counted at once.
COUNT_ROWS = 65_536

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def shingle_hashes(text: str | None, words: int = SHINGLE_WORDS, seed: int = SEED) -> np.ndarray:
    """XXH64 of each shingle; of the whole sequence if it has fewer words; none without words."""
    found = WORD.findall((text or "").encode().translate(LOWER))
    if not found:
        return np.zeros(0, np.uint64)
    if len(found) <= words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(found), seed)], np.uint64)
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
    starts = np.concatenate(([0], ends[:-words]))
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts.tolist(), (ends[words - 1 :] - 1).tolist(), strict=True)), np.uint64, len(starts))


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is set if over half of the hashes have it."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), COUNT_ROWS):
        part = hashes[at : at + COUNT_ROWS]
        counts += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def with_fingerprints(docs: DataFrame, key: str, text: str, words: int = SHINGLE_WORDS, seed: int = SEED) -> DataFrame:
    """Key and ``fp`` (a signed 64-bit integer). A null text has no words; its fingerprint is 0."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([signed(fingerprint(shingle_hashes(x, words, seed))) for x in batch.column(1).to_pylist()], pa.int64())], ["_key", "fp"])

    return docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).mapInArrow(run, f"_key {kind}, fp bigint").withColumnRenamed("_key", key)


class BKTree:
    """Integers under Hamming distance; a node's children are keyed by their distance to it."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> int:
        """The node of the value; a value that is there isn't added again."""
        own = len(self.values)
        if not own:
            self.values.append(value)
            self.children.append({})
            return 0
        node, values, children = 0, self.values, self.children
        while d := (value ^ values[node]).bit_count():
            below = children[node].get(d)
            if below is None:
                children[node][d] = own
                values.append(value)
                children.append({})
                return own
            node = below
        return node

    def within(self, value: int, radius: int) -> list[int]:
        """Nodes at most ``radius`` away."""
        if not self.values:
            return []
        out, left, values, children = [], [0], self.values, self.children
        while left:
            node = left.pop()
            d = (value ^ values[node]).bit_count()
            if d <= radius:
                out.append(node)
            if below := children[node]:
                low, high = d - radius, d + radius
                left += [c for k, c in below.items() if low <= k <= high]
        return out


def forest(members: list[int], own: list[bool], radius: int) -> list[tuple[int, int]]:
    """Edges that span the links among members, save those with both ends not ``own`` (another shard has these)."""
    tree, roots = BKTree(), list(range(len(members)))

    def root(x: int) -> int:
        while roots[x] != x:
            roots[x] = x = roots[roots[x]]
        return x

    edges = []

    def link(found: list[int], new: int) -> None:
        for x in found:
            a, b = root(x), root(new)
            if a != b:
                roots[max(a, b)] = min(a, b)
                edges.append((members[x], members[new]))

    order = [i for i, o in enumerate(own) if o]
    nodes: list[int] = []  # member of each node
    for i in order:
        link([nodes[n] for n in tree.within(members[i], radius)], i)
        if tree.add(members[i]) == len(nodes):
            nodes.append(i)
    for i, o in enumerate(own):
        if not o:
            link([nodes[n] for n in tree.within(members[i], radius)], i)
    return edges


def _shard_edges(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Edges of shards whose rows (shard, own, fp) lie together; holds one shard at a time."""
    names, out = ["a", "b"], []
    shard, fps, own = None, [], []
    mask = (1 << 64) - 1

    def done() -> None:
        out.extend(forest([x & mask for x in fps], own, radius))

    for batch in batches:
        for s, o, x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if s != shard:
                if len(fps) > 1:
                    done()
                shard, fps, own = s, [], []
            fps.append(x)
            own.append(o)
        if len(out) >= 10_000:
            yield pa.RecordBatch.from_arrays([pa.array([signed(e[i]) for e in out], pa.int64()) for i in (0, 1)], names)
            out.clear()
    if len(fps) > 1:
        done()
    yield pa.RecordBatch.from_arrays([pa.array([signed(e[i]) for e in out], pa.int64()) for i in (0, 1)], names)


def _blocks(shared: list[tuple[int, int]], bits: int) -> list[list[tuple[int, int]]]:
    """The bits (as runs (low, width)) outside ``shared``, cut into four blocks of ``bits``."""
    taken = {b for low, width in shared for b in range(low, low + width)}
    free = [b for b in range(64) if b not in taken]
    return [[(b, 1) for b in free[i * bits : (i + 1) * bits]] for i in range(4)]


def _mask(block: list[tuple[int, int]]) -> int:
    return sum(1 << low for low, _ in block)


def dealt(fps: DataFrame, shard_rows: int = SHARD_ROWS, block_bits: tuple[int, ...] = BLOCK_BITS) -> DataFrame:
    """(shard, own, fp): every two of the distinct ``fp`` at most 3 bits apart meet in a shard, at least one of them own there."""
    # A path names the blocks that a shard's members share; its mask has their bits.
    level = fps.select("fp", F.lit(0).cast("long").alias("mask"), F.lit("").alias("path"))
    paths: dict[str, int] = {"": 0}
    small: list[DataFrame] = []
    for depth, bits in enumerate(block_bits):
        masks = {}
        for path, mask in paths.items():
            shared = [(b, 1) for b in range(64) if mask >> b & 1]
            for i, block in enumerate(_blocks(shared, bits)):
                masks[f"{path}{i}"] = mask | _mask(block)
        choices = {p: [(f"{p}{i}", masks[f"{p}{i}"]) for i in range(4)] for p in paths}
        # The new path and mask of each of four copies, from its path before.
        options = reduce(lambda c, p: F.when(F.col("path") == p, F.array(*(F.struct(F.lit(n).alias("path"), F.lit(signed(m)).cast("long").alias("mask")) for n, m in choices[p]))).otherwise(c) if c is not None else F.array(*(F.struct(F.lit(n).alias("path"), F.lit(signed(m)).cast("long").alias("mask")) for n, m in choices[p])), choices, None)
        copies = level.select("fp", F.explode(options).alias("o")).select("fp", F.col("o.path").alias("path"), F.col("fp").bitwiseAND(F.col("o.mask")).alias("value"))
        sizes = copies.groupBy("path", "value").agg(F.count("*").alias("n")).filter("n > 1")
        held = copies.join(sizes, ["path", "value"])
        if depth < len(block_bits) - 1:
            held = written(held, f"simhash-level-{depth}")
        small.append(held.filter(F.col("n") <= shard_rows).select(F.struct("path", "value", F.lit(0).alias("i"), F.lit(0).alias("j")).alias("shard"), F.lit(True).alias("own"), "fp"))
        hot = held.filter(F.col("n") > shard_rows)
        paths, level = masks, hot
    # What is still hot: parts of a bounded size, and a shard for each pair of parts.
    parts = F.ceil(F.col("n") / shard_rows).cast("int")
    own = F.pmod(F.xxhash64("fp"), parts).cast("int")
    pairs = level.withColumn("_part", own).withColumn("_other", F.explode(F.sequence(F.lit(0), parts - 1)))
    paired = pairs.select(F.struct("path", "value", F.least("_part", "_other").alias("i"), F.greatest("_part", "_other").alias("j")).alias("shard"), (F.col("_part") <= F.col("_other")).alias("own"), "fp")
    return reduce(DataFrame.unionByName, [*small, paired])


def fingerprint_edges(fps: DataFrame, radius: int = RADIUS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(a, b): edges that connect just those distinct fingerprints that links connect."""
    if radius > 3:
        raise ValueError("four blocks find differences of up to 3 bits")
    shards = dealt(fps, shard_rows).withColumn("shard", F.xxhash64("shard"))
    # By a hash of 64 bits: shards that share one are only searched together.
    placed = shards.repartition(F.col("shard")).sortWithinPartitions("shard", F.desc("own"))
    return placed.select("shard", "own", "fp").mapInArrow(lambda b: _shard_edges(b, radius), "a bigint, b bigint").distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node that edges (a, b) lead to, for each node with an edge.

    Large-star links a node's larger neighbours to its smallest one, small-star
    its smaller ones; both in turn until nothing changes. Only whether the
    edges changed comes to the driver: a count and a sum of hashes.
    """
    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v"))
        if large:
            both = both.unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        else:
            both = e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        joined = both.join(least, "u")
        moved = joined.filter(F.col("v") > F.col("u")) if large else joined
        out = moved.select(F.col("v").alias("a"), F.col("m").alias("b"))
        if not large:
            out = out.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
        return out.filter("a <> b").distinct()

    now = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "components")
    mark = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    before = mark(now)
    for _ in range(most_rounds):
        if not before[0]:
            break
        now = written(star(star(now, True), False), "components")
        after = mark(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components didn't settle in {most_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS, words: int = SHINGLE_WORDS) -> DataFrame:
    """One row a row of ``docs``: key, fp, and component: the smallest key of all texts that links lead to.

    Null and empty texts have fingerprint 0 and link like others. A null key
    has its fingerprint's component; among keys it counts as none. Repeated
    rows are kept. Other columns are left out.
    """
    seen = written(with_fingerprints(docs, key, text, words), "simhash")
    distinct = written(seen.groupBy("fp").agg(F.min(key).alias("_least")), "simhash-distinct")
    joined = components(fingerprint_edges(distinct.select("fp"), radius))
    heads = distinct.join(joined.select(F.col("node").alias("fp"), F.col("component").alias("_root")), "fp", "left").withColumn("_root", F.coalesce("_root", "fp"))
    least = heads.groupBy("_root").agg(F.min("_least").alias("component"))
    classes = heads.join(least, "_root").select("fp", "component")
    return seen.join(classes, "fp").select(key, "fp", "component")


def op4_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate component of every document."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
