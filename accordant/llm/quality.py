"""Quality classification: histogram gradient-boosted trees over document statistics.

Statistics are computed from whole texts. Trees are grown level by level on
binned features, with gradients and hessians summed into histograms, and are
kept as complete binary trees in flat arrays, so that scoring is ``DEPTH``
vectorised steps for all rows and trees at once. Training is on the driver, on
at most ``TRAIN_ROWS`` labelled rows, those with the lowest hashes of their
ids; the bound is a parameter. Scoring is a map over rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from accordant.llm.common import bound_batches, table

TRAIN_ROWS = 20_000
TREES, DEPTH, BINS = 80, 4, 64
LEARNING_RATE, L2, MIN_CHILD = 0.15, 1.0, 2.0

NAMES = (
    "log_bytes", "log_words", "bytes_per_word", "letters", "upper", "digits", "spaces", "line_ends", "marks", "symbols", "bars", "beyond_ascii", "entropy",
    "distinct_words", "top_word", "short_words", "long_words", "symbol_words", "distinct_lines", "words_per_line", "lines_ended", "lines_upper", "words_per_mark", "capital_words", "distinct_pairs",
)

#: Classes of bytes (fixed values): letters, capitals, digits, spaces, line ends, marks of prose, a bar, other ASCII, others.
CLASS = np.full(256, 7, np.uint8)
CLASS[128:] = 8
for _members, _class in ((b"abcdefghijklmnopqrstuvwxyz", 0), (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", 1), (b"0123456789", 2), (b" \t\r\x0b\x0c", 3), (b"\n", 4), (b".,;:!?'\"-()", 5), (b"|", 6)):
    CLASS[list(_members)] = _class
SYMBOLS = frozenset("#$%&*|@^~<>{}[]\\/_=+`")


def statistics(text: str | None) -> list[float]:
    """One number for each of NAMES; all 0 for a null, empty or blank text but for its length."""
    text = text or ""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    words = text.split()
    n, k = len(raw), len(words)
    if not k:
        return [float(np.log1p(n))] + [0.0] * (len(NAMES) - 1)
    each = np.bincount(raw, minlength=256)
    classes = np.bincount(CLASS, each, 9) / n
    p = each[each > 0] / n
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    sizes = np.fromiter(map(len, words), np.int64, k)
    marks = max(1.0, classes[5] * n)
    return [
        float(np.log1p(n)), float(np.log1p(k)), n / k, classes[0], classes[1], classes[2], classes[3], classes[4], classes[5], classes[6] + classes[7], classes[6], classes[8], float(-(p * np.log2(p)).sum()),
        len(counts) / k, max(counts.values()) / k, float((sizes <= 3).mean()), float((sizes >= 12).mean()), sum(c for w, c in counts.items() if w[-1] in SYMBOLS) / k, len(set(lines)) / max(1, len(lines)), k / max(1, len(lines)),
        sum(x.rstrip()[-1] in ".!?" for x in lines) / max(1, len(lines)), sum(x.lstrip()[0].isupper() for x in lines) / max(1, len(lines)), k / marks, sum(c for w, c in counts.items() if w[0].isupper()) / k, len(set(zip(words, words[1:], strict=False))) / k,
    ]


def matrix(texts: list[str | None]) -> np.ndarray:
    return np.array([statistics(x) for x in texts], np.float64).reshape(-1, len(NAMES))


@dataclass
class Trees:
    """Complete binary trees: inner node i of a tree has children 2i+1 and 2i+2; leaves are the last level."""

    base: float
    feature: np.ndarray  # (trees, inner nodes)
    threshold: np.ndarray  # (trees, inner nodes): rows with a feature above it go right
    value: np.ndarray  # (trees, leaves)

    def raw(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros((len(x), len(self.feature)), np.int64)
        trees, rows = np.arange(len(self.feature))[None, :], np.arange(len(x))[:, None]
        for _ in range(self.depth):
            node = 2 * node + 1 + (x[rows, self.feature[trees, node]] > self.threshold[trees, node])
        return self.base + self.value[trees, node - self.feature.shape[1]].sum(1)

    @property
    def depth(self) -> int:
        return int(np.log2(self.value.shape[1])) if len(self.value) else 0

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -40, 40))) if len(x) else np.zeros(0)


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, rate: float = LEARNING_RATE) -> Trees:
    """Logistic loss. Without rows, or with labels of one kind only, the trees are just that kind's prior."""
    n, width = x.shape
    inner = (1 << depth) - 1
    prior = (y.sum() + 0.5) / (n + 1.0)
    base = float(np.log(prior / (1 - prior)))
    empty = Trees(base, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)))
    if not n or y.min() == y.max():
        return empty
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(width)]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], 1)
    raw = np.full(n, base)
    out = ([], [], [])
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = y - p, p * (1 - p)
        node = np.zeros(n, np.int64)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(depth):
            k, first = 1 << level, (1 << level) - 1
            flat = ((node - first)[:, None] * width + np.arange(width)) * bins + binned
            size = k * width * bins
            gs = np.bincount(flat.ravel(), np.repeat(g, width), size).reshape(k, width, bins).cumsum(2)
            hs = np.bincount(flat.ravel(), np.repeat(h, width), size).reshape(k, width, bins).cumsum(2)
            ga, ha = gs[:, :1, -1:], hs[:, :1, -1:]
            gain = gs**2 / (hs + L2) + (ga - gs) ** 2 / (ha - hs + L2) - ga**2 / (ha + L2)
            gain = np.where((hs >= MIN_CHILD) & (ha - hs >= MIN_CHILD), gain, -1.0)
            best = gain.reshape(k, -1).argmax(1)
            split = np.full(k, bins, np.int64)
            for i, b in enumerate(best):
                if gain.reshape(k, -1)[i, b] > 1e-9:
                    j, at = divmod(int(b), bins)
                    if at < len(cuts[j]):
                        feature[first + i], threshold[first + i], split[i] = j, cuts[j][at], at
            own = node - first
            node = 2 * node + 1 + (binned[np.arange(n), feature[node]] > split[own])
        leaf = node - inner
        value = rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + L2)
        raw += value[leaf]
        for a, b in zip(out, (feature, threshold, value), strict=True):
            a.append(b)
    return Trees(base, *(np.array(a) for a in out))


def features(text: Column) -> Column:
    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([statistics(x if isinstance(x, str) else None) for x in texts])

    return run(text)


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Trees:
    """Learn ``quality`` (1 or 0) from documents with a label. Labels of one id are averaged; null ids, texts and labels are left out."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("_y"))
    # A bounded number of ids and labels: safe to broadcast.
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    found = docs.filter(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("doc_id", "_y", features(F.col("text")).alias("_x"))
    got = found.groupBy("doc_id").agg(F.first("_y").alias("_y"), F.min("_x").alias("_x")).orderBy("doc_id").toPandas()
    x = np.stack(got["_x"].to_list()) if len(got) else np.zeros((0, len(NAMES)))
    return fit(x, got["_y"].to_numpy(np.float64))


def scores(spark: SparkSession, trees: Trees, text: Column) -> Column:
    """Score (0 to 1) of a text column. Null and empty texts have one too."""
    bound_batches(spark)
    shared = spark.sparkContext.broadcast(trees)

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(shared.value.score(matrix([x if isinstance(x, str) else None for x in texts])), dtype="float64")

    return run(text)


def fold(key: str, parts: int) -> Column:
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % parts


def op7_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores for all documents by trees that haven't seen labels of those whose crc32(id) mod 3 is 1."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    trees = train(docs, labels.filter(fold("doc_id", 3) != 1))
    out = docs.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), scores(spark, trees, F.col("text")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that score below 0.5 go. The trees learn from the labels of the stage's own documents."""
    trees = train(docs, table(spark, sf_dir, "labels"))
    return docs.filter(scores(spark, trees, F.col("text")) >= 0.5)
