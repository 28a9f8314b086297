import math

import pytest

from accordant.functions import special as s


@pytest.mark.parametrize(("x", "k", "p"), [(3.841, 1, 0.05), (7.815, 3, 0.05), (11.345, 3, 0.01), (5.991, 2, 0.05)])
def test_chi_square_critical_values(x, k, p):
    assert s.chi2_sf(x, k) == pytest.approx(p, abs=1e-3)
    assert s.chi2_isf(p, k) == pytest.approx(x, abs=1e-2)


def test_chi_square_even_degrees_are_poisson_sums():
    for k, x in ((2, 0.7), (10, 12.5), (64, 70.0)):
        assert s.chi2_sf(x, k) == pytest.approx(math.exp(-x / 2) * math.fsum((x / 2) ** i / math.factorial(i) for i in range(k // 2)), rel=1e-12)
    assert s.chi2_sf(0, 4) == 1 and math.isnan(s.chi2_sf(-1, 4)) and s.chi2_sf(math.inf, 2) == 0


def test_window_at_and_over_its_target():
    assert 0.4 < s.chi2_sf(64 * 3.0, 192) < 0.6
    assert s.chi2_sf(64 * 15.0, 192) < 1e-6


def test_intervals():
    low, high = s.wilson(0, 10)
    assert low == 0 and 0 < high < 0.35
    assert s.garwood(0, 2.0)[0] == 0 and s.garwood(0, 2.3993)[1] == pytest.approx(1.5375, abs=2e-4)
    assert s.garwood(63, 2.3993)[0] < 26.2573 < s.garwood(63, 2.3993)[1]
    assert s.hoeffding(0.5, 100, 0, 1) == pytest.approx((0.5 - math.sqrt(math.log(40) / 200), 0.5 + math.sqrt(math.log(40) / 200)))
    assert s.envelope((0, 1), (-1, 0.5)) == (-1, 1) and s.bartlett_n_eff(128, 0.9) == pytest.approx(13.4, abs=0.05)


def test_ranks_differ():
    x = [float(i) for i in range(1, 11)]
    assert (s.median(x), s.nearest_rank(x, 0.95), s.floor_percentile(x, 0.95), s.rounded_quantile(x, 0.95)) == (5.5, 10, 9, 10)
    assert s.median([]) is None and s.nearest_rank([], 0.5) is None


def test_hashes_and_digamma():
    assert s.fnv1a64(b"") == 0xCBF29CE484222325 and s.fnv1a64(b"a") == 0xAF63DC4C8601EC8C
    assert s.splitmix64(0) == (0x9E3779B97F4A7C15, 0xE220A8397B1DCDAF)
    assert s.digamma(1) == pytest.approx(-0.5772156649) and s.digamma(5) == pytest.approx(1.5061176684)
