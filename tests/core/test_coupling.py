import pytest

from accordant.operators import coupling


def test_information_sees_what_correlation_misses(spark):
    got = {(r.study, r.measure): r for r in coupling.score_aucs(coupling.coupling_scores(spark), ("rho", "mi")).collect()}
    assert got["linear", "rho"].auc == got["linear", "mi"].auc == 1.0
    assert got["nonlinear", "mi"].auc == 1.0 and got["nonlinear", "rho"].auc < 0.95
    assert got["linear", "rho"]["mean"] == pytest.approx(0.893, abs=0.02) and got["linear", "mi"]["mean"] == pytest.approx(0.80, abs=0.08) and got["nonlinear", "mi"]["mean"] == pytest.approx(0.41, abs=0.08)


def test_parity_needs_both_sources(spark):
    got = {r.measure: r for r in coupling.score_aucs(coupling.parity_scores(spark, trials=10), ("rho", "pairwise", "joint")).collect()}
    assert got["joint"].auc == 1.0 and got["rho"].auc < 0.9 and got["pairwise"].auc < 0.95
    assert got["joint"]["mean"] == pytest.approx(0.5, abs=0.2)


def test_autocorrelation_inflates_the_naive_floor(spark):
    got = {(r.phi, r.alpha, r.floor): r for r in coupling.null_rates(spark, 400).collect()}
    assert got[0.9, 0.05, "naive"].rate == pytest.approx(0.297, abs=0.08) and got[0.9, 0.01, "naive"].rate == pytest.approx(0.226, abs=0.08)
    assert got[0.9, 0.05, "bartlett"].high < 0.09 and got[0.0, 0.05, "naive"].low <= 0.05 <= got[0.0, 0.05, "naive"].high
    assert coupling.n_eff(0.9) == pytest.approx(13.4, abs=0.05)
