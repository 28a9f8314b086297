import zlib

import numpy as np
from pyspark.sql import functions as F

from accordant.llm import quality


def plain_score(trees, row):
    raw = trees.base
    for f, t, v in zip(trees.feature, trees.threshold, trees.value, strict=True):
        node = 0
        while node < len(f):
            node = 2 * node + (2 if row[f[node]] > t[node] else 1)
        raw += v[node - len(f)]
    return 1 / (1 + np.exp(-raw))


def test_trees_learn_and_flat_arrays_equal_walks():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > -0.2)).astype(float)
    trees = quality.fit(x[:1500], y[:1500], trees=40, depth=3)
    assert ((trees.score(x[1500:]) >= 0.5) == y[1500:]).mean() > 0.95
    np.testing.assert_allclose(trees.score(x[:50]), [plain_score(trees, r) for r in x[:50]])


def test_labels_of_one_kind_or_none():
    assert quality.fit(np.zeros((0, 3)), np.zeros(0)).score(np.zeros((2, 3))).tolist() == [0.5, 0.5]
    assert (quality.fit(np.zeros((5, 3)), np.ones(5)).score(np.zeros((1, 3))) > 0.9).all()
    assert len(quality.fit(np.ones((4, 3)), np.array([0, 1, 0, 1.0])).score(np.zeros((0, 3)))) == 0


def test_statistics_of_hard_texts():
    for text in (None, "", " \n\t", "\x00", "a", "### ###", "é" * 10, "　", "x\n\n\ny z", "w " * 50_000):
        row = quality.statistics(text)
        assert len(row) == len(quality.NAMES) and np.isfinite(row).all()


def test_query_on_hard_rows(spark):
    good, bad = "This is a fine sentence, with words. ", "a### | b%%% | "
    rows = [(i, (good if i % 2 else bad) * (1 + i % 3), "s") for i in range(60)] + [(None, good, "s"), (61, None, "s"), (62, "", "s"), (1, good * 2, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)] + [(None, 1, 0), (5, None, 0), (7, 1, 0), (99, 1, 1)], "doc_id long, quality int, toxic int")
    trees = quality.train(docs, labels)
    got = docs.select("doc_id", quality.scores(spark, trees, F.col("text")).alias("p")).collect()
    assert len(got) == len(rows) and all(0 <= r.p <= 1 for r in got)
    assert all((r.p >= 0.5) == bool(r.doc_id % 2) for r in got if r.doc_id is not None and r.doc_id < 60)
    assert docs.limit(0).select(quality.scores(spark, quality.train(docs.limit(0), labels), F.col("text"))).count() == 0


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = quality.op7_query(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").collect()
    assert sum(r.predicted == r.quality for r in got) / len(got) > 0.95
    assert all(zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in got)
