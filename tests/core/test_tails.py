import math

import pytest

from accordant.functions.special import chi2_sf
from accordant.functions.tails import chi2_right


def test_equals_the_incomplete_gamma_function(spark):
    cases = [(x, k) for k in (1, 2, 3, 4, 5, 31, 64, 95, 96, 191, 192) for x in (1e-9, 0.01, 0.5, 1.0, 3.99, 7.99, 8.01, 30.0, 96.0, 192.0, 250.0, 700.0, 1_400.0)]
    rows = spark.createDataFrame(cases, "x double, k int").withColumn("p", chi2_right("x", "k")).collect()
    for r in rows:
        want = chi2_sf(r.x, r.k)
        assert r.p == pytest.approx(want, rel=2e-10, abs=1e-300), (r.x, r.k)
    assert min(r.p for r in rows if r.k == 192) > 0


def test_ends_and_what_has_no_tail(spark):
    cases = [(0.0, 3), (math.inf, 3), (-1.0, 3), (math.nan, 3), (None, 3), (2.0, None), (2.0, 0), (1e5, 3), (1e300, 4)]
    rows = spark.createDataFrame(cases, "x double, k int").withColumn("p", chi2_right("x", "k")).collect()
    assert [r.p for r in rows] == [1.0, 0.0, None, None, None, None, None, 0.0, 0.0]
