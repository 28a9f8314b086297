import math
import random

import pytest

from accordant.operators import exact


def sums(spark, lists, length):
    rows = [(k, i, x) for k, xs in enumerate(lists) for i, x in enumerate(xs)]
    frame = spark.createDataFrame(rows, "k int, i int, x double").repartition(3)
    out = exact.window_sums(frame, "x", ("k",), "i", length)
    return {(r.k, r.i): r["sum"] for r in out.collect()}


def test_equals_the_correctly_rounded_sum(spark):
    """Window sums equal math.fsum bit by bit: mild values, halfway cases, subnormal, huge and mixed ones."""
    rng = random.Random(8)
    lists = [
        [rng.expovariate(0.3) for _ in range(80)],
        [rng.choice([0.0, 1e-9, 3.0, 1e17, 2.5e22]) * rng.random() for _ in range(80)],
        [2.0**53, 1.0, 2.0**-30, 1.0, 1.0, 2.0**53, 1.0, 0.0, 1.0, 2.0**-80, 1.0, 2.0**53],
        [1.0, 2.0**-53, 2.0**-83, 1.0, 2.0**-53, 1.0 + 2.0**-52, 2.0**-53],
        [5e-324, 5e-324, 2.2e-308, 1e-310, 0.0, 1e-320],
        [math.ldexp(rng.random(), rng.randrange(-1080, 1015)) for _ in range(60)],
        [2.0**77, 1.0, 2.0**-60, 1e300, 2.0**-1074, 1e-300, 3.0],
        [0.0, 0.0, 0.0],
    ]
    for length in (1, 4, 16):
        got = sums(spark, lists, length)
        for k, xs in enumerate(lists):
            for i in range(len(xs)):
                assert got[k, i] == math.fsum(xs[max(0, i - length + 1) : i + 1]), (length, k, i)


def test_saturates_and_checks(spark):
    got = sums(spark, [[1.7e308, 1.7e308, 1.0, 2.0]], 2)
    assert [got[0, i] for i in range(4)] == [1.7e308, 1.7976931348623157e308, 1.7e308, 3.0]
    assert sums(spark, [], 3) == {}
    with pytest.raises(ValueError):
        exact.window_sums(spark.createDataFrame([], "k int, i int, x double"), "x", ("k",), "i", 0)
