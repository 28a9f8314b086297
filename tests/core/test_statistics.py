import random
from statistics import mean, pstdev

import pytest
from pyspark.sql import functions as F

from accordant.operators import statistics


def test_resamples_spread_as_the_auc_does(spark):
    """Poisson resamples: centred on the AUC, about as wide as its standard error, paired across scores, and told by keys alone."""
    rng = random.Random(2)
    rows = [(i * 7, i % 3 == 0, rng.gauss(0.5 if i % 3 == 0 else 0.0, 1), 1.0) for i in range(600)] + [(None, True, None, 1.0)]
    frame = spark.createDataFrame(rows, "k long, pos boolean, a double, b double")
    told = statistics.bootstrap_auc(frame, "k", F.col("pos"), ("a", "b"), 120).collect()
    a = [r.auc for r in told if r.score == "a"]
    whole = statistics.auc(frame.withColumn("g", F.lit(1)), ["g"], "a", F.col("pos")).first().auc
    assert len(a) == 120 and mean(a) == pytest.approx(whole, abs=0.01)
    # Hanley and McNeil's standard error
    q1, q2 = whole / (2 - whole), 2 * whole * whole / (1 + whole)
    error = ((whole * (1 - whole) + 199 * (q1 - whole**2) + 399 * (q2 - whole**2)) / (200 * 400)) ** 0.5
    assert pstdev(a) == pytest.approx(error, rel=0.35)
    assert {r.auc for r in told if r.score == "b"} == {0.5}
    assert {r.n_pos + r.n_neg for r in told if r.score == "a"} != {600} and 570 < mean(r.n_pos + r.n_neg for r in told if r.score == "a") < 630
    again = statistics.bootstrap_auc(frame.orderBy(F.desc("a")).repartition(5), "k", F.col("pos"), ("a",), 120).collect()
    assert sorted((r.replicate, r.auc) for r in again) == sorted((r.replicate, r.auc) for r in told if r.score == "a")
