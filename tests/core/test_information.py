import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from accordant import views
from accordant.operators import correlation, fusion, information as info, magnitude
from accordant.config import DetectorConfig


def test_ksg_of_gaussians():
    rng = np.random.default_rng(0)
    x = rng.standard_normal(500)
    for rho in (0.0, 0.6, 0.9):
        y = rho * x + math.sqrt(1 - rho * rho) * rng.standard_normal(500)
        assert info.ksg(x, y) == pytest.approx(-0.5 * math.log(1 - rho * rho), abs=0.1)


def test_ksg_equals_a_plain_count():
    rng = np.random.default_rng(1)
    x, y = rng.standard_normal((2, 40))
    total = 0.0
    for i in range(40):
        d = sorted(max(abs(x[i] - x[j]), abs(y[i] - y[j])) for j in range(40) if j != i)[2]
        nx, ny = (sum(abs(v[i] - v[j]) < d for j in range(40) if j != i) for v in (x, y))
        total += info.digamma(nx + 1) + info.digamma(ny + 1)
    assert info.ksg(x, y) == pytest.approx(info.digamma(3) + info.digamma(40) - total / 40)


def columns(kind, n=128, seed=3):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal(n)
    near = lambda: base + 0.3 * rng.standard_normal(n)
    third = {"same": near, "apart": lambda: rng.standard_normal(n), "constant": lambda: np.ones(n), "sign": lambda: rng.choice([-1.0, 1.0], n) * near()}[kind]()
    return {"visual": near(), "acoustic": third, "radar": near()}


def test_consensus_verdicts():
    cfg = info.PidConfig(resamples=30)
    assert info.analyse(columns("same"), cfg).verdict == "nominal"
    apart = info.analyse(columns("apart"), cfg)
    assert (apart.verdict, apart.decoupled) == ("decoupled", ("acoustic",))
    assert info.analyse(columns("constant"), cfg).verdict == "insufficient"
    # a random sign hides the coupling from correlation, not from information
    assert info.analyse(columns("sign"), info.PidConfig(resamples=0, decouple_ratio=0.2)).verdict == "nominal"
    assert info.analyse(columns("same", 40), cfg).verdict == "insufficient"
    assert info.analyse(columns("apart"), cfg) == apart


def test_block_plans():
    plans = info.delete_block_plans(20, 5, 20, 7)
    assert all(len(p) == 15 and len(set(p)) == 15 for p in plans)
    assert len({tuple(p) for p in plans}) == 20
    with pytest.raises(ValueError):
        info.delete_block_plans(5, 5, 1, 1)
    with pytest.raises(ValueError, match="more resamples"):
        info.delete_block_plans(20, 5, 21, 7)


def test_atoms_of_xor_and_copy():
    xor = info.xor_atoms_bits({(x, y, x ^ y): 0.25 for x in (0, 1) for y in (0, 1)})
    assert xor["joint"] == pytest.approx(1.0) and xor["redundancy"] == pytest.approx(math.log2(2 / 3)) and xor["synergy"] == pytest.approx(1 + math.log2(2 / 3))
    assert xor["redundancy"] + xor["unique_x"] + xor["unique_y"] + xor["synergy"] == pytest.approx(1.0)
    same = info.xor_atoms_bits({(0, 0, 0): 0.5, (1, 1, 1): 0.5})
    assert same["redundancy"] == pytest.approx(1.0) and same["synergy"] == pytest.approx(0.0)


def test_reports_of_a_scenario(spark):
    cfg = DetectorConfig()
    rows = magnitude.generations(views.scenario(spark, "/root/testdata/sf0.001"), cfg)
    wide = magnitude.frames(magnitude.channel_reports(magnitude.channel_windows(rows, cfg), cfg, 3), views.CHANNELS, fusion.PROVENANCE)
    out = info.pid_reports(correlation.aligned(wide, cfg, views.CHANNELS), views.CHANNELS, info.PidConfig(resamples=10)).collect()
    assert len(out) == 6 and all(r.n == 128 for r in out)
    assert {r.pid_channels for r in out if r.pid_verdict == "decoupled"} <= {"acoustic"} and any(r.pid_verdict == "decoupled" for r in out)
    assert F is not None


@pytest.mark.parametrize(("axes", "verdict"), [(3, "insufficient"), (1, "decoupled")])
def test_alpha_is_shared_by_axes_and_bounds(monkeypatch, axes, verdict):
    """2 of 100 replicates contradict: 0.10 / 2 bears that, 0.10 / (3 axes x 2) doesn't."""
    plans = [[1.0, 0.0, 0.0]] * 99 + [[1.0, 1.0, 0.0]] * 2
    values = iter([v for plan in plans for v in plan])
    monkeypatch.setattr(info, "ksg", lambda x, y: next(values))
    monkeypatch.setattr(info, "geometry_sound", lambda x, y, cfg: True)
    rng = np.random.default_rng(3)
    columns = {m: rng.standard_normal(128) for m in views.CHANNELS[:3]}
    assert info.analyse(columns, info.PidConfig(), 0, axes).verdict == verdict


def test_queries_have_the_operators_settings(monkeypatch):
    from accordant.plans import research

    seen = []
    for name in ("magnitude.generations", "magnitude.channel_windows", "magnitude.channel_reports", "magnitude.frames", "correlation.aligned", "views.scenario"):
        monkeypatch.setattr(f"accordant.plans.research.{name}", lambda *a: None)
    monkeypatch.setattr(research.information, "pid_reports", lambda frames, mods, cfg: seen.append(cfg))
    research.pid_reports(None, "")
    assert seen == [info.PidConfig()]
