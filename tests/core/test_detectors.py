import itertools
import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from accordant.config import CorrelationConfig, DetectorConfig
from accordant.operators import correlation, fusion, magnitude
from accordant.schema import CODES

MODS = ("visual", "acoustic", "radar")
CFG = DetectorConfig(window_len=8, min_samples=4)


def observations(spark, rows):
    """rows: (track, seq, modality, nis, projection or None[, timestamp])"""
    full = []
    for track, seq, modality, nis, p, *ts in rows:
        x = (float(p), float(p) * 0.5, -float(p)) if p is not None else (None,) * 3
        ids = (1, 1, seq + 1) if p is not None else (None,) * 3
        full.append((track, seq, ts[0] if ts else seq * 100, modality, CODES[modality], float(nis), 3, *x, *ids))
    return spark.createDataFrame(full, "track_id long, seq long, timestamp_ms long, modality string, code int, nis double, dof int, p0 double, p1 double, p2 double, frame_id long, context_id long, prior_id long")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.floats(0, 50), max_size=60))
def test_cusum_closed_form(values):
    """The running sum less its running minimum is the recursion."""
    hi = total = low = 0.0
    for x in values:
        step = x - 3 - 0.5
        hi = max(0.0, hi + step)
        total += step
        low = min(low, total)
        assert total - low == pytest.approx(hi, abs=1e-9)


def test_windows_evict(spark):
    rows = observations(spark, [(1, i, "visual", v, None) for i, v in enumerate([1, 2, 3, 4])]).withColumn("generation", F.lit(0))
    last = magnitude.channel_windows(rows, DetectorConfig(window_len=3, min_samples=1)).orderBy(F.desc("seq")).first()
    assert (last.n, last.sum_nis, last.mean_nis) == (3, 9.0, 3.0)


def test_windows_forget(spark):
    """What was huge leaves no trace once it has left the window; a sum that no double holds is the largest one."""
    values = [3.0] * 10 + [1e17] + [3.0] * 20 + [1.7e308, 1.7e308] + [3.0] * 20
    rows = magnitude.generations(observations(spark, [(1, i, "visual", v, None) for i, v in enumerate(values)]), CFG)
    got = [(r.sum_nis, r.mean_nis, r.elevated) for r in magnitude.channel_reports(magnitude.channel_windows(rows, CFG), CFG, 1).orderBy("seq").collect()]
    assert got[10][2] and got[17][2] and got[18] == (24.0, 3.0, False) and got[30] == (24.0, 3.0, False)
    assert got[32][:2] == (math.ldexp(2.0 - 2.0**-52, 1023), pytest.approx(1.7e308 / 4)) and got[32][2]
    assert got[40] == (24.0, 3.0, False) == got[-1]


def test_correlation_forgets(spark):
    rng = random.Random(3)
    base = [rng.gauss(0, 1) for _ in range(60)]
    series = {m: [b + 0.3 * rng.gauss(0, 1) for b in base] for m in MODS}
    clean = corr_states(spark, series, CorrelationConfig(window=20, min_samples=8))
    spoilt = {m: [1e12 if i == 15 else x for i, x in enumerate(v)] for m, v in series.items()}
    after = corr_states(spark, spoilt, CorrelationConfig(window=20, min_samples=8))
    assert [after[f"r_0_{i}_{j}"] for i, j in ((0, 1), (0, 2), (1, 2))] == pytest.approx([clean[f"r_0_{i}_{j}"] for i, j in ((0, 1), (0, 2), (1, 2))], abs=1e-12)


def test_rejected_rows_are_no_evidence(spark):
    """A repeat, other degrees of freedom, a late clock, nulls and an unexpected channel change nothing and are told."""
    good = [(1, i, m, 3, None) for i in range(12) for m in MODS]
    frame = observations(spark, good)
    last = frame.filter("modality = 'radar' and seq = 11")
    bad = (
        last.withColumns({"nis": F.lit(900.0), "timestamp_ms": F.col("timestamp_ms") + 5})
        .unionByName(last.withColumns({"seq": F.lit(12).cast("long"), "dof": F.lit(2), "nis": F.lit(900.0), "timestamp_ms": F.lit(1200).cast("long")}))
        .unionByName(last.withColumns({"seq": F.lit(12).cast("long"), "nis": F.lit(900.0)}))
        .unionByName(last.withColumns({"seq": F.lit(13).cast("long"), "modality": F.lit("lidar"), "timestamp_ms": F.lit(1300).cast("long")}))
        .unionByName(last.withColumns({"seq": F.lit(14).cast("long"), "nis": F.lit(float("nan"))}))
        .unionByName(last.withColumns({"seq": F.lit(14).cast("long"), "timestamp_ms": F.lit(None).cast("long")}))
    )
    rows = frame.unionByName(bad)
    assessed = lambda r: sorted(map(str, fusion.assessed_frames(r, MODS, CFG, CorrelationConfig(window=8, min_samples=4)).collect()))
    assert assessed(rows) == assessed(frame)
    told = sorted((r.seq, r.reject) for r in magnitude.rejected(rows, CFG, MODS).collect())
    assert told == [(11, "sequence_not_increasing"), (12, "dof_changed"), (12, "timestamp_not_increasing"), (13, "unexpected_modality"), (14, "incomplete"), (14, "invalid_value")]
    assert magnitude.generations(frame.limit(0), CFG).count() == 0


def plain_fold(rows, cfg):
    """Generations row by row, from the rules: rows are (track, seq, timestamp, modality, dof, nis) in order."""
    out, state, generation, at = {}, {}, 0, None
    for (track, seq), frame in itertools.groupby(rows, key=lambda r: r[:2]):
        if track != at:
            at, state, generation = track, {}, 0
        took = {}
        for r in frame:
            before = took.get(r[3]) or state.get(r[3])
            if before is None or (r[1] > before[1] and r[4] == before[4] and r[2] > before[2]):
                took[r[3]] = r
        if any(m in state and (r[1] - state[m][1] > cfg.max_seq_gap or r[2] - state[m][2] > cfg.max_inter_sample_gap_ms) for m, r in took.items()):
            state, generation = {}, generation + 1
        state = state | took
        out |= {r: generation for r in took.values()}
    return out


def test_generations_equal_plain_rules(spark):
    """Random gaps, repeats, clocks and dof over tracks, in Arrow batches that end anywhere."""
    rng = random.Random(12)
    rows = set()
    for track in range(6):
        for seq in range(80):
            for m in MODS:
                for _ in range(rng.choice((0, 1, 1, 1, 1, 1, 1, 2))):
                    rows.add((track, seq, seq * 1000 + rng.choice((0, 0, 0, 1, 900, 2500)), m, rng.choice((3,) * 30 + (2,)), float(rng.randrange(1, 9))))
    cfg = DetectorConfig(window_len=8, min_samples=4, max_seq_gap=2, max_inter_sample_gap_ms=4000)
    frame = spark.createDataFrame(list(rows), "track_id long, seq long, timestamp_ms long, modality string, dof int, nis double")
    want = plain_fold(sorted(rows), cfg)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for size in ("1", "7", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        got = {(r.track_id, r.seq, r.timestamp_ms, r.modality, r.dof, r.nis): r.generation for r in magnitude.generations(frame, cfg).collect()}
        assert got == want
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert max(want.values()) > 3 and len(want) < len(rows)


def verdicts(spark, rows, mods=MODS, cfg=CFG):
    reports = magnitude.channel_reports(magnitude.channel_windows(magnitude.generations(observations(spark, rows), cfg), cfg), cfg, len(mods))
    return {(r.generation, r.seq): (r.magnitude_verdict, r.magnitude_channels) for r in magnitude.magnitude_verdict(magnitude.frames(reports, mods), cfg, mods).collect()}


def test_magnitude_ladder(spark):
    def stream(level):
        return [(1, i, m, level(m, i), None) for i in range(12) for m in MODS]

    assert verdicts(spark, stream(lambda m, i: 3))[0, 11] == ("nominal", "")
    assert verdicts(spark, stream(lambda m, i: 3))[0, 2] == ("insufficient", "")
    assert verdicts(spark, stream(lambda m, i: 30 if m == "radar" else 3))[0, 11] == ("attributed", "radar")
    assert verdicts(spark, stream(lambda m, i: 30 if m != "radar" else 3))[0, 11] == ("broad", "visual,acoustic")
    sensitive = DetectorConfig(window_len=8, min_samples=4, cusum_slack=0.2, cusum_threshold=5)
    assert verdicts(spark, stream(lambda m, i: 0.0 if m == "visual" else 3), cfg=sensitive)[0, 11] == ("unclassified", "visual")
    late = [(1, i, m, 30 if m == "radar" else 3, None, i * 5000 + (2000 if m == "radar" else 0)) for i in range(12) for m in MODS]
    assert verdicts(spark, late)[0, 11] == ("unclassified", "radar")


def test_a_gap_before_the_generation_is_no_gap(spark):
    rows = [(1, i, m, 3, None) for i in range(20) for m in MODS if not (m == "acoustic" and i in (5, 9)) and not (m == "radar" and 4 <= i <= 7)]
    got = {(r.modality, r.seq): r.generation for r in magnitude.generations(observations(spark, rows), CFG).collect()}
    # acoustic returns at 6: reset; radar returns at 8 from before that reset: none; acoustic again at 10
    assert got["visual", 5] == 0 and got["visual", 6] == 1 and got["radar", 8] == 1 and got["acoustic", 8] == 1 and got["acoustic", 10] == 2


def corr_states(spark, series, cfg=None):
    n = len(next(iter(series.values())))
    rows = [(1, i, m, 3, v[i]) for m, v in series.items() for i in range(n)]
    cfg = cfg or CorrelationConfig(window=64, min_samples=32)
    mods = tuple(series)
    out = fusion.assessed_frames(observations(spark, rows), mods, CFG, cfg)
    return out.filter(F.col("seq") == n - 1).first()


def test_correlation_verdicts(spark):
    rng = random.Random(5)
    base = [rng.gauss(0, 1) for _ in range(80)]
    noise = lambda: [rng.gauss(0, 1) for _ in range(80)]
    near = lambda x, k=0.2: [a + k * rng.gauss(0, 1) for a in x]
    assert corr_states(spark, {"visual": near(base), "acoustic": near(base), "radar": near(base)}).corr_0 == "nominal"
    out = corr_states(spark, {"visual": near(base), "acoustic": noise(), "radar": near(base)})
    assert (out.corr_0, out.mask_0, out.fused_verdict, out.fused_channels, out.fused_magnitude) == ("decoupled", 2, "attributed", "acoustic", "in_covariance")
    flipped = corr_states(spark, {"visual": near(base), "acoustic": [-x for x in near(base)], "radar": near(base)})
    assert (flipped.corr_0, flipped.mask_0) == ("decoupled", 2)
    constant = corr_states(spark, {"visual": near(base), "acoustic": [1.0] * 80, "radar": near(base)})
    assert (constant.corr_0, constant.consistency_status, constant.fused_verdict) == ("error", "analysis_error", "insufficient")
    assert corr_states(spark, {"visual": near(base), "acoustic": near(base)}).corr_0 == "insufficient"
    other = noise()
    dyads = corr_states(spark, {"visual": near(base, 0.05), "thermal": near(base, 0.05), "acoustic": near(other, 0.05), "radar": near(other, 0.05)})
    assert dyads.corr_0 == "insufficient"


def test_rolling_correlation_equals_two_passes(spark):
    rng = random.Random(8)
    x, y, z = ([1e6 + rng.gauss(0, 1) for _ in range(150)] for _ in range(3))
    rows = [(1, i, m, 3, v[i]) for m, v in (("visual", x), ("acoustic", y), ("radar", z)) for i in range(150)]
    wide = magnitude.frames(magnitude.channel_reports(magnitude.channel_windows(magnitude.generations(observations(spark, rows), CFG), CFG), CFG, 3), MODS, fusion.PROVENANCE)
    got = correlation.pair_correlations(correlation.aligned(wide, CFG, MODS), CorrelationConfig(window=40, min_samples=8).for_axes(3), MODS).orderBy("seq").collect()
    for r in got[10:]:
        a, b = (v[max(0, r.seq - 39) : r.seq + 1] for v in (x, y))
        ma, mb = math.fsum(a) / len(a), math.fsum(b) / len(b)
        want = math.fsum((p - ma) * (q - mb) for p, q in zip(a, b, strict=True)) / math.sqrt(math.fsum((p - ma) ** 2 for p in a) * math.fsum((q - mb) ** 2 for q in b))
        assert r.r_0_0_1 == pytest.approx(want, abs=1e-7)


def plain_fusion(v, own, c, dec):
    """The ladder row by row, over sets."""
    if c == "conflicted":
        return "unclassified", own | dec, None
    if v == "unclassified":
        return "unclassified", own | dec, None
    if v == "insufficient" and c == "insufficient":
        return "insufficient", set(), None
    if c == "decoupled":
        if v in ("attributed", "broad") and own != dec:
            return "unclassified", own | dec, None
        both = own | dec
        kind = "insufficient" if v == "insufficient" else "in_covariance" if not both & own else "elevated" if both <= own else "mixed"
        return "attributed", both, kind
    if v in ("broad", "attributed"):
        return v, own if v == "attributed" else set(), "elevated" if v == "attributed" else None
    if v == "nominal" and c == "intact":
        return "nominal", set(), None
    return "insufficient", set(), None


def test_fusion_over_all_evidence(spark):
    rows = []
    for v, c in itertools.product(("nominal", "insufficient", "attributed", "broad", "unclassified"), ("intact", "decoupled", "insufficient", "conflicted")):
        for own, dec in itertools.product(range(8), range(8)):
            if (v in ("nominal", "insufficient")) == (own == 0) and (c in ("decoupled", "conflicted")) == (dec > 0):
                rows.append((v, own, c, dec))
    out = fusion.combine(spark.createDataFrame(rows, "magnitude_verdict string, magnitude_mask int, consistency string, consistency_mask int")).collect()
    assert len(out) == len(rows) > 100
    bits = lambda m: {i for i in range(3) if m >> i & 1}
    for r in out:
        verdict, channels, kind = plain_fusion(r.magnitude_verdict, bits(r.magnitude_mask), r.consistency, bits(r.consistency_mask))
        assert (r.fused_verdict, bits(r.fused_mask), r.fused_magnitude) == (verdict, channels, kind), r


def test_one_exchange_keys_by_track(spark):
    out = fusion.assessed_frames(observations(spark, [(1, 0, m, 3, 1.0) for m in MODS]), MODS, CFG, CorrelationConfig(window=8, min_samples=4))
    plan = out._jdf.queryExecution().executedPlan().toString()
    keys = {line.split("hashpartitioning(")[1].split(",")[0].split("#")[0] for line in plan.splitlines() if "Exchange hashpartitioning" in line}
    assert keys == {"track_id"}


@pytest.mark.parametrize("bad", [{"window_len": 0}, {"min_samples": 65}, {"nis_alpha": 1.0}, {"jam_fraction": 0}, {"cusum_threshold": 0}, {"min_channels": 1}])
def test_configurations_are_checked(bad):
    with pytest.raises(ValueError):
        DetectorConfig(**bad)


def test_family_budget_is_divided_once():
    cfg = CorrelationConfig().for_axes(3)
    with pytest.raises(ValueError):
        cfg.for_axes(3)
    assert cfg.significance_floor(128, 3) > CorrelationConfig().significance_floor(128, 3) > CorrelationConfig().significance_floor(128, 2)
    assert CorrelationConfig(family_alpha=1e-18).significance_floor(128, 3) == 1.0


def test_correlation_has_no_unit(spark):
    """Scaled and shifted projections give the same verdicts; constant columns stay errors."""
    from accordant import views
    from accordant.plans.detectors import CORR, DETECTOR, FUSED

    rows = views.scenario(spark, "/root/testdata/sf0.001").filter("track_id = 0").cache()
    told = lambda r: sorted(map(str, fusion.assessed_frames(r, MODS, DETECTOR, CORR).select(*FUSED).collect()))
    want = told(rows)
    assert sum("assessed'" in x and "insufficient" not in x for x in want) > 50
    for scale, shift in ((1e-9, 0.0), (1e-160, 0.0), (1e160, 0.0), (1.0, 1e9), (-1.0, 0.0)):
        moved = rows.withColumns({c: F.col(c) * F.lit(scale) + F.lit(shift) for c in ("p0", "p1", "p2")})
        assert told(moved) == want, (scale, shift)
    still = rows.withColumn("p1", F.when(F.col("modality") == "radar", F.lit(7.25e200)).otherwise(F.col("p1")))
    states = {r.consistency_status for r in fusion.assessed_frames(still, MODS, DETECTOR, CORR).filter("w >= 64").collect()}
    assert states == {"analysis_error"}


def test_reused_priors_are_no_evidence(spark):
    rows = observations(spark, [(1, i, m, 3, None) for i in range(20) for m in MODS])
    rng_ = random.Random(4)
    noisy = {(i, m): rng_.gauss(0, 1) for i in range(20) for m in MODS}
    values = spark.createDataFrame([(i, m, v) for (i, m), v in noisy.items()], "seq long, modality string, v double")
    rows = rows.join(values, ["seq", "modality"]).withColumns({c: F.col("v") for c in ("p0", "p1", "p2")}).drop("v")
    rows = rows.withColumns({"frame_id": F.lit(1).cast("long"), "context_id": F.lit(1).cast("long"), "prior_id": F.col("seq")})
    status = lambda r: [x.consistency_status for x in fusion.assessed_frames(r, MODS, CFG, CorrelationConfig(window=8, min_samples=4)).orderBy("seq").collect()]
    assert "extraction_error" not in status(rows)
    reused = F.when(F.col("seq") == 12, F.lit(3).cast("long")).otherwise(F.col("prior_id"))
    again = status(rows.withColumn("prior_id", reused))
    assert again[:12] == status(rows)[:12] and set(again[12:]) == {"extraction_error"}
    # A channel that nobody asked for uses a prior again: that counts too.
    other = rows.filter("modality = 'radar' and seq = 15").withColumns({"modality": F.lit("lidar"), "prior_id": F.lit(2).cast("long")})
    seen = status(rows.unionByName(other))
    assert seen[:15] == status(rows)[:15] and set(seen[15:]) == {"extraction_error"}


def test_many_rows_without_sequence_are_told_as_they_come(spark):
    """Rows without a sequence, or of one sequence, are refused one by one; none is held back."""
    from accordant.operators import ordering

    good = observations(spark, [(1, i, m, 3, None) for i in range(3) for m in MODS])
    lost = good.filter("seq = 1").crossJoin(spark.range(4000)).drop("id")
    rows = good.unionByName(lost.withColumn("seq", F.lit(None).cast("long"))).unionByName(lost)
    told = {(r.reject, r["count"]) for r in ordering.checked(rows, CFG, MODS).groupBy("reject").count().collect()}
    assert told == {(None, 9), ("incomplete", 12000), ("sequence_not_increasing", 12000)}


def test_retained_frames_are_the_newest(spark):
    """By buckets or by whole tracks, the same rows; rows without a sequence are none."""
    rng_ = random.Random(9)
    rows = [(t, s, m) for t in (1, 2, 3) for s in rng_.sample(range(200), 20 * t) for m in ("radar", "visual")] + [(1, None, "radar")]
    frame = spark.createDataFrame(rows, "track_id long, seq long, modality string")
    for frames, bucket in ((1, 7), (25, 10), (40, 1), (60, 1_000), (1_000, 16)):
        want = []
        for t in (1, 2, 3):
            newest = sorted({s for u, s, _ in rows if u == t and s is not None})[-frames:]
            want += [r for r in rows if r[0] == t and r[1] in newest]
        assert sorted(map(tuple, correlation.retained(frame, frames, bucket).collect())) == sorted(want)
