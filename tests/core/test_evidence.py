import pytest

from accordant.operators import evidence as e

CFG = e.StudyConfig(tracks=3, frames=600, onset=300, mission_frames=600, resamples=40, min_eligible=2)


@pytest.fixture(scope="module")
def table(spark):
    found = e.records(spark, CFG).toPandas()
    assert len(found) == 2 * 3 * len(CFG.conditions()) and (found.assessments == 60).all()
    return e.metrics(found, CFG).set_index(["condition", "detector", "metric"])


def test_conditions_do_what_they_say(table):
    value = lambda c, d, m: table.loc[(c, d, m), "value"]
    low = f"clean_covariance_scale_{e.float_id(1.3)}"
    assert value(low, "fused", "episodes_per_hour") == 0 and value(low, "fused", "arl0") == 60
    assert value(f"clean_covariance_scale_{e.float_id(0.7)}", "magnitude", "episodes_per_hour") > 20
    assert value("clean_ordinary_missingness", "magnitude", "abstention") > 0.9
    assert value("provenance_invalid_prior", "fused", "abstention") == 1 and value("provenance_invalid_prior", "fused", "any_alert") == 0
    assert value("provenance_missing_projection", "fused", "abstention") > 0.9
    for d in ("magnitude", "fused"):
        assert value("attack_loud_acoustic", d, "detected") == 1 and value("attack_loud_acoustic", d, "delay_frames") == 9 and value("attack_loud_acoustic", d, "attribution_correct") == 1
    assert 20 <= value("attack_stealthy_acoustic", "fused", "delay_frames") <= 140
    assert ((table.low.isna()) | (table.low <= table.value + 1e-12)).all() and ((table.high.isna()) | (table.value <= table.high + 1e-12)).all()
    assert not e.accepted(table.reset_index())


def test_seeds_are_exact():
    seed = e.trial_seed(e.StudyConfig(), "clean_ordinary_missingness", "holdout", 0)
    assert 0 <= seed < 2**64 and seed != e.trial_seed(e.StudyConfig(), "clean_ordinary_missingness", "calibration", 0)
    assert 1 <= e.track_id(seed) < 2**53
    share = sum(e.is_missing(seed, f, "acoustic", 0.15) for f in range(4000)) / 4000
    assert 0.12 < share < 0.18 and not any(e.is_missing(seed, f, "radar", 0.15) for f in range(100))
    assert e.float_id(0.5) == "0p500000_3fe0000000000000"


def test_study_size_is_bounded():
    with pytest.raises(ValueError):
        e.StudyConfig(tracks=10_000)
    with pytest.raises(ValueError):
        e.StudyConfig(onset=3_600)
