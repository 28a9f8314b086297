"""Near copies by the similarity of whole shingle sets: all pairs of Jaccard similarity 0.8 or more over five words.

Texts that are that similar have fingerprints some ten bits apart, so links
within 3 bits are too few for them. The classes are the components of all pairs
whose whole shingle sets have the similarity, found in two steps:

1. Links that are cheap to find: fingerprints within 3 bits, through the
   BK-trees of ``simhash``, and texts that agree in a band of their sketches.
   A band links each of its texts to the least one of them, so a group of any
   size takes a link a member and not one a pair. Each link is verified by the
   whole sets; what is left joins most texts of a large group.
2. The pairs that are still missing: a prefix-filtered join of the sets, between
   different components only, verified likewise. No pair is left to chance.

Prefixes hold a set's rarest shingles. How common a shingle is, is counted over
all documents in ``COUNTERS`` hashed counters, so what is broadcast has a fixed
size; counts only order shingles, and any order finds all pairs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from accordant.llm.common import fresh, slices, written
from accordant.llm.simhash import LOWER, SEED, SHARD_ROWS, components, fingerprint, fingerprint_edges, signed

WORDS = 5
SIMILARITY = 0.8
#: The similarity as a fraction, so that whole sets are judged in integers.
SHARE = Fraction(SIMILARITY).limit_denominator(1000)
#: Bins of a sketch, and bins of each of its bands. Two texts of similarity 0.8 agree in a band with a chance of 0.95.
BINS, BAND_BINS = 128, 8
EMPTY = np.uint64(np.iinfo(np.uint64).max)
#: Blanks between words, the base of word hashes, and bytes of a text that are hashed at once.
BLANK, BASE, PIECE = re.compile(rb"[\x20\x09-\x0D]"), np.uint64(0x100000001B3), 1 << 20
IS_BLANK = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
#: Hashed counters of how many texts have a shingle, and the rows that they are summed in.
COUNTERS, COUNTER_ROWS = 1 << 16, 64
#: Words of a set's bitmap: each shingle flips one of their bits.
MAP_WORDS = 8
#: Tasks that a component of any size is spread over.
SALTS = 32


def mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one mix of 64-bit values."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def word_hashes(text: bytes) -> np.ndarray:
    """A hash of each word: its bytes as a polynomial in an odd base."""
    out = []
    at = 0
    while at < len(text):
        # Pieces end after a blank, so that a long text takes bounded memory unless a word is as long.
        cut = BLANK.search(text, at + PIECE)
        stop = cut.end() if cut else len(text)
        b = np.frombuffer(text, np.uint8, stop - at, at)
        at = stop
        inside = np.flatnonzero(~IS_BLANK[b])
        if not len(inside):
            continue
        first = np.flatnonzero(np.concatenate(([True], np.diff(inside) > 1)))
        place = np.arange(len(inside)) - np.repeat(first, np.diff(np.append(first, len(inside))))
        powers = np.multiply.accumulate(np.full(int(place.max()) + 1, BASE, np.uint64))
        out.append(np.add.reduceat((b[inside].astype(np.uint64) + np.uint64(1)) * powers[place], first))
    return mixed(np.concatenate(out)) if out else np.zeros(0, np.uint64)


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """A hash of each run of ``words`` words, lower-cased (A-Z); of the whole text if it has fewer; none without words."""
    found = word_hashes((text or "").encode().translate(LOWER))
    runs = max(1, len(found) - words + 1) if len(found) else 0
    out = np.full(runs, min(words, len(found)), np.uint64)
    for i in range(min(words, len(found))):
        out = mixed(out * BASE + found[i : i + runs])
    return out


def distinct_shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    return np.unique(shingles(text, words))


def sketch(found: np.ndarray) -> np.ndarray:
    """Of distinct sorted shingles the least in each bin of the hash range; the largest value for an empty bin."""
    out = np.full(BINS, EMPTY, np.uint64)
    b = (found >> np.uint64(57)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], b[1:] != b[:-1]))) if len(b) else b
    out[b[first]] = found[first]
    return out


def bands(sketches: np.ndarray) -> list[np.ndarray]:
    """Of each sketch (a row) a hash of each band that has a shingle, or one for all texts without shingles."""
    cut = sketches.reshape(len(sketches), -1, BAND_BINS)
    out = np.broadcast_to(np.arange(cut.shape[1], dtype=np.uint64), cut.shape[:2])
    for i in range(BAND_BINS):
        out = mixed(out * BASE + cut[:, :, i])
    filled = (cut != EMPTY).any(axis=2)
    return [h[f].view(np.int64) if f.any() else np.zeros(1, np.int64) for h, f in zip(out, filled, strict=True)]


def bitmap(found: np.ndarray) -> bytes:
    """Parities of how many shingles fall on each bit. Two sets' bitmaps differ in no more bits than the sets in shingles."""
    at = (found >> np.uint64(20)) & np.uint64(MAP_WORDS * 64 - 1)
    odd = np.bincount(at.astype(np.int64), minlength=MAP_WORDS * 64) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def set_id(found: np.ndarray) -> int:
    return signed(xxhash.xxh64_intdigest(found.tobytes(), SEED))


def counter_of(found: np.ndarray) -> np.ndarray:
    return (found & np.uint64(COUNTERS - 1)).astype(np.int64)


def shingle_counts(docs: DataFrame, text: str, words: int = WORDS) -> np.ndarray:
    """Over all documents: how many have a shingle of each hashed counter."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.int64)
        for batch in slices(batches):
            for t in batch.column(0).to_pylist():
                np.add.at(total, counter_of(distinct_shingles(t, words)), 1)
        parts = total.reshape(COUNTER_ROWS, -1)
        rows = [pa.array(range(COUNTER_ROWS), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())]
        yield pa.RecordBatch.from_arrays(rows, ["place", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for place, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = totals.setdefault(place, np.zeros(COUNTERS // COUNTER_ROWS, np.int64))
                own += np.frombuffer(counts, np.int64)
        rows = [pa.array(totals, pa.int32()), pa.array([t.tobytes() for t in totals.values()], pa.binary())]
        yield pa.RecordBatch.from_arrays(rows, ["place", "counts"])

    schema = "place int, counts binary"
    parts = docs.select(F.col(text).alias("_text")).mapInArrow(count, schema).repartition(F.col("place"))
    total = np.zeros((COUNTER_ROWS, COUNTERS // COUNTER_ROWS), np.int64)
    for place, counts in parts.mapInArrow(add, schema).collect():  # COUNTER_ROWS rows
        total[place] = np.frombuffer(counts, np.int64)
    return total.reshape(-1)


def least_overlap(n: int) -> int:
    """Shingles that a set of ``n`` has in common with any set of a similarity of ``SIMILARITY``, at least."""
    return -(-SHARE.numerator * n // SHARE.denominator)


def ordered_prefix(found: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Of distinct sorted shingles the first ones, rare before common: similar sets share one of these."""
    if not len(found):
        return found
    ranked = np.argsort(counts[counter_of(found)], kind="stable")
    return found[ranked[: len(found) - least_overlap(len(found)) + 1]]


def with_sets(docs: DataFrame, key: str, text: str, words: int = WORDS) -> DataFrame:
    """``_key``, ``_mark`` (hash of the text), ``fp``, ``bands``; of the set of shingles: hash ``sid``, size ``n``, ``prefix``, ``bitmap``."""
    kind = docs.schema[key].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(shingle_counts(docs, text, words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            hashes = [shingles(x, words) for x in batch.column(2).to_pylist()]
            sets = [np.unique(h) for h in hashes]
            columns = [
                *batch.columns[:2],
                pa.array([signed(fingerprint(h)) for h in hashes], pa.int64()),
                pa.array(bands(np.array([sketch(x) for x in sets])), pa.list_(pa.int64())),
                pa.array([set_id(x) for x in sets], pa.int64()),
                pa.array([len(x) for x in sets], pa.int32()),
                pa.array([ordered_prefix(x, shared.value).tobytes() for x in sets], pa.binary()),
                pa.array([bitmap(x) for x in sets], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["_key", "_mark", "fp", "bands", "sid", "n", "prefix", "bitmap"])

    rows = docs.select(F.col(key).alias("_key"), F.xxhash64(text).alias("_mark"), F.col(text).alias("_text"))
    schema = f"_key {kind}, _mark bigint, fp bigint, bands array<bigint>, sid bigint, n int, prefix binary, bitmap binary"
    return rows.mapInArrow(run, schema)


def band_edges(nodes: DataFrame) -> DataFrame:
    """(a, b): each ``sid`` with two of each band that it shares: the one whose bands are shared most, and the least one.

    In a group of copies the text that others were made from shares all its
    bands, so most members are linked to it. A member has two links a band at
    most, however large the group.
    """
    rows = nodes.select("sid", F.explode("bands").alias("band"))
    sizes = rows.groupBy("band").agg(F.count("*").alias("_n")).filter("_n > 1")
    shared = written(rows.join(sizes, "band"), "similar-bands")
    score = shared.groupBy("sid").agg(F.sum(F.log2("_n")).alias("_score"))
    scored = shared.select("sid", "band").join(score, "sid")
    centre = scored.groupBy("band").agg(F.max_by("sid", F.struct("_score", "sid")).alias("_most"), F.min("sid").alias("_least"))
    linked = shared.select("sid", "band").join(centre, "band").select("sid", F.explode(F.array("_most", "_least")).alias("b"))
    return linked.filter("sid <> b").select(F.greatest("sid", "b").alias("a"), F.least("sid", "b").alias("b")).distinct()


def jaccard_reaches(a: bytes, b: bytes) -> bool:
    """Whether two sets of distinct shingles have a Jaccard similarity of ``SIMILARITY`` or more."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    if SHARE.numerator * max(len(x), len(y)) > SHARE.denominator * min(len(x), len(y)):
        return False
    both = len(x) + len(y) - len(np.union1d(x, y))
    return both * SHARE.denominator >= SHARE.numerator * (len(x) + len(y) - both)


def verified_pairs(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, key: str, text: str, words: int = WORDS) -> DataFrame:
    """Those pairs (a, b) of ``sid`` whose whole shingle sets have the similarity. ``nodes`` has a row (``_key``, ``_mark``) of each."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [distinct_shingles(x, words).tobytes() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["sid", "shingles"])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            two = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)
            yield batch.select(["a", "b"]).filter(pa.array([jaccard_reaches(x, y) for x, y in two], pa.bool_()))

    wanted = nodes.join(pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct(), "sid", "left_semi")
    rows = docs.select(F.col(key).alias("_key"), F.xxhash64(text).alias("_mark"), F.col(text).alias("_text"))
    # Repeated rows give the same set. Rows without a key meet as null.
    meet = rows["_key"].eqNullSafe(wanted["_key"]) & (rows["_mark"] == wanted["_mark"])
    placed = rows.join(wanted, meet).select("sid", "_text").mapInArrow(sets, "sid bigint, shingles binary")
    placed = written(placed.dropDuplicates(["sid"]), "similar-sets")
    left, right = (placed.select(F.col("sid").alias(c), F.col("shingles").alias(f"_{c}")) for c in ("a", "b"))
    judged = pairs.join(left, "a").join(right, "b").select("a", "b", "_a", "_b").mapInArrow(judge, "a bigint, b bigint")
    return written(judged, "similar-verified")


def _prefix_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row a shingle of a prefix: token, at (its place in the prefix), sid, n and part."""
    for batch in slices(batches):
        found = [np.frombuffer(x, np.int64) for x in batch.column(3).to_pylist()]
        times = [len(x) for x in found]
        columns = [np.repeat(batch.column(i).to_numpy(), times) for i in range(3)]
        tokens = pa.array(np.concatenate([*found, np.zeros(0, np.int64)]))
        at = pa.array(np.concatenate([*map(np.arange, times), np.zeros(0, np.int64)]), pa.int32())
        yield pa.RecordBatch.from_arrays([tokens, at, *map(pa.array, columns)], ["token", "at", "sid", "n", "part"])


def may_reach(one: list[np.ndarray], others: list[np.ndarray]) -> np.ndarray:
    """Which of ``others`` (n, at, bitmap; sizes not below) may be so similar to ``one``, if the shingle they meet at is their first in common.

    Sets of sizes a and b are similar if they share ``need`` shingles, so if
    they differ in at most a + b - 2 need. Neither has more shingles from the
    meeting one on than its size less its place, and the bits in which bitmaps
    differ are no more than the shingles in which the sets do.
    """
    (a, place, own), (b, places, maps) = one, others
    num, den = SHARE.numerator, SHARE.denominator
    need = -(-num * (a + b) // (num + den))
    ok = (a - place >= need) & (b - places >= need)
    ok[ok] = np.bitwise_count(maps[ok] ^ own).sum(1, dtype=np.int64) <= (a + b - 2 * need)[ok]
    return ok


def _meeting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of each shard that may be similar, of different parts and sides.

    Rows are shard, side, n, sid, part, at and bitmap in order of shard and n.
    A pair that is similar has a first shingle in common, and is told there.
    """
    names = ["a", "b"]
    out: list[list[np.ndarray]] = [[], []]
    rows = 0
    left: list[np.ndarray] | None = None

    def search(group: list[np.ndarray]) -> None:
        nonlocal rows
        _, side, n, sid, part, at, maps = group
        if (part == part[0]).all():
            return
        ends = np.searchsorted(n, n * SHARE.denominator // SHARE.numerator, "right")
        for i in range(len(n) - 1):
            j = slice(i + 1, ends[i])
            ok = np.flatnonzero((part[j] != part[i]) & ((side[j] < 0) | (side[j] != side[i]))) + i + 1
            if len(ok):
                ok = ok[may_reach([n[i], at[i], maps[i]], [n[ok], at[ok], maps[ok]])]
                out[0].append(np.minimum(sid[ok], sid[i]))
                out[1].append(np.maximum(sid[ok], sid[i]))
                rows += len(ok)

    def drain() -> Iterator[pa.RecordBatch]:
        nonlocal rows
        pairs = np.unique(np.stack([np.concatenate([*x, np.zeros(0, np.int64)]) for x in out], 1), axis=0)
        for x in out:
            x.clear()
        for at in range(0, max(1, len(pairs)), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(pairs[at : at + 100_000, i], pa.int64()) for i in (0, 1)], names)
        rows = 0

    def groups(columns: list[np.ndarray], whole: bool) -> list[np.ndarray]:
        """Searches each shard; gives back the last one, which may go on, if not ``whole``."""
        cuts = np.concatenate(([0], np.flatnonzero(columns[0][1:] != columns[0][:-1]) + 1, [len(columns[0])]))
        stop = len(cuts) - 1 if whole else len(cuts) - 2
        for g in np.flatnonzero(np.diff(cuts[: stop + 1]) > 1):
            search([c[cuts[g] : cuts[g + 1]] for c in columns])
        return [c[cuts[stop] :] for c in columns]

    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [c.to_numpy().astype(np.int64) for c in batch.columns[:-1]]
        columns.append(np.frombuffer(b"".join(batch.column(6).to_pylist()), np.uint64).reshape(-1, MAP_WORDS))
        whole = columns if left is None else [np.concatenate(x) for x in zip(left, columns, strict=True)]
        left = groups(whole, False)
        if rows >= 1_000_000:
            yield from drain()
    if left is not None:
        groups(left, True)
    yield from drain()


def missing_pairs(nodes: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(a, b): every two ``sid`` of other components (``part``) that may have the similarity; none that has it is left out.

    Sets of that similarity share a shingle of their prefixes. Shingles of one
    prefix, or of prefixes of one component, meet none. Shingles of more than
    ``shard_rows`` prefixes are cut into parts, and each pair of parts is a
    shard. What can't be similar by sizes, places in the prefixes or bitmaps
    isn't told (``may_reach``).
    """
    kept = nodes.select("sid", "n", "part", "prefix")
    keyed = kept.mapInArrow(_prefix_rows, "token bigint, at int, sid bigint, n int, part bigint")
    counts = keyed.groupBy("token").agg(F.count("*").alias("_rows"), F.min("part").alias("_least"), F.max("part").alias("_most"))
    met = written(counts.filter("_least < _most").select("token", "_rows"), "similar-tokens")
    shared = written(keyed.join(met, "token").join(nodes.select("sid", "bitmap"), "sid"), "similar-shared")
    small = shared.filter(F.col("_rows") <= shard_rows)
    row = ("n", "sid", "part", "at", "bitmap")
    small = small.select(F.col("token").alias("shard"), F.lit(-1).cast("tinyint").alias("side"), *row)
    pieces = F.ceil(F.col("_rows") / shard_rows).cast("int")
    hot = shared.filter(F.col("_rows") > shard_rows).withColumn("_p", F.pmod(F.xxhash64("sid"), pieces).cast("int"))
    pairs = hot.withColumn("_o", F.explode(F.sequence(F.lit(0), pieces - 1)))
    side = F.when(F.col("_p") == F.col("_o"), -1).when(F.col("_p") < F.col("_o"), 0).otherwise(1).cast("tinyint")
    shard = F.xxhash64("token", F.least("_p", "_o"), F.greatest("_p", "_o"))
    placed = small.unionByName(pairs.select(shard.alias("shard"), side.alias("side"), *row))
    placed = placed.repartition(F.col("shard")).sortWithinPartitions("shard", "n")
    return placed.mapInArrow(_meeting, "a bigint, b bigint").distinct()


def set_classes(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``_key``, ``_mark``, ``fp`` and the class (``root``) of each row of ``docs``."""
    seen = written(with_sets(docs, key, text), "similar")
    # Rows of one shingle set are alike, and links are between sets. But for key and mark they agree.
    same = (F.first(c).alias(c) for c in ("fp", "n", "bands", "prefix", "bitmap"))
    nodes = seen.groupBy("sid").agg(F.min(F.struct("_key", "_mark")).alias("_row"), *same)
    nodes = written(nodes.select("sid", "_row.*", "fp", "n", "bands", "prefix", "bitmap"), "similar-nodes")
    keys = nodes.select("sid", "_key", "_mark")
    prints = nodes.groupBy("fp").agg(F.min("sid").alias("sid"))
    near = fingerprint_edges(prints.select("fp"))
    near = near.join(prints.select(F.col("fp").alias("a"), F.col("sid").alias("x")), "a")
    near = near.join(prints.select(F.col("fp").alias("b"), F.col("sid").alias("y")), "b").select("x", "y")
    twins = nodes.select("fp", F.col("sid").alias("x")).join(prints.withColumnRenamed("sid", "y"), "fp").select("x", "y")
    near = near.unionByName(twins.filter("x <> y")).select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b"))
    proposed = written(near.unionByName(band_edges(nodes)).distinct(), "similar-proposed")
    links = verified_pairs(proposed, keys, docs, key, text)
    parts = components(links).select(F.col("node").alias("sid"), F.col("component").alias("part"))
    parted = nodes.select("sid", "n", "prefix", "bitmap").join(parts, "sid", "left").withColumn("part", F.coalesce("part", "sid"))
    rest = verified_pairs(written(missing_pairs(parted), "similar-missing"), keys, docs, key, text)
    # What was missing links whole components.
    left, right = (parts.select(F.col("sid").alias(c), F.col("part").alias(f"_{c}")) for c in ("a", "b"))
    between = rest.join(left, "a", "left").join(right, "b", "left")
    roots = components(between.select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b")))
    roots = roots.select(F.col("node").alias("part"), F.col("component").alias("root"))
    rows = seen.select("_key", "_mark", "fp", "sid").join(parts, "sid", "left")
    rows = rows.withColumn("part", F.coalesce("part", "sid")).join(roots, "part", "left")
    return written(rows.select("_key", "_mark", "fp", F.coalesce("root", "part").alias("root")), "similar-rows")


def similar_classes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a row of ``docs``: key, fp and ``component``, the smallest key that links lead to.

    Null, empty and blank texts have fingerprint 0 and are one class. Null
    keys are of a class but name none. Repeated rows are kept. Other columns
    are left out, whatever their names; a key named fp or component is refused.
    """
    if key.lower() in ("fp", "component"):
        raise ValueError(f"a key can't be named {key}")
    rows = set_classes(docs, key, text)
    least = rows.groupBy("root").agg(F.min("_key").alias("component"))
    # A class may hold a third of all rows: its rows go to SALTS tasks.
    least = least.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("_key", "_mark"), F.lit(SALTS)).cast("int"))
    return salted.join(least, ["root", "_salt"]).select(F.col("_key").alias(key), "fp", "component")


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str = "") -> DataFrame:
    """Pipeline stage: of each class of near copies the document with the smallest id stays.

    Texts of one id are told apart by a hash: of several in a class one stays,
    and of repeated rows one. Documents without an id can't be told apart from
    each other's copies by id and stay.
    """
    rows = set_classes(docs.filter(F.col("doc_id").isNotNull()), "doc_id", "text")
    keep = rows.groupBy("root").agg(F.min(F.struct("_key", "_mark")).alias("_row"))
    mark, number = fresh(docs, "_mark"), fresh(docs, "_number")
    keep = keep.select(F.col("_row._key").alias("doc_id"), F.col("_row._mark").alias(mark))
    kept = docs.withColumn(mark, F.xxhash64("text")).join(keep, ["doc_id", mark], "left_semi")
    once = kept.withColumn(number, F.row_number().over(Window.partitionBy("doc_id", mark).orderBy("doc_id")))
    return once.filter(F.col(number) == 1).select(*docs.columns).unionByName(docs.filter(F.col("doc_id").isNull()))
