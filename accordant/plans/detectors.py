"""Detector queries over the observation views, and the same in SQL, written another way: with window frames instead of running sums."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from accordant import views
from accordant.config import CorrelationConfig, DetectorConfig
from accordant.functions.tails import chi2_right
from accordant.operators import correlation, exact, fusion, magnitude
from accordant.schema import canonical

MODS = canonical(views.CHANNELS)
DETECTOR, CORR = DetectorConfig(), CorrelationConfig()
#: For the short runs of a capture, and for the few rows that a user has.
SHORT_DETECTOR, SHORT_CORR = DetectorConfig(window_len=16, min_samples=8), CorrelationConfig(window=32, min_samples=16)
EVENT_DETECTOR = DetectorConfig(window_len=8, min_samples=4, max_inter_sample_gap_ms=10 * 86_400_000, max_timestamp_skew_ms=86_400_000)


def _r(*columns: str) -> list:
    return [F.round(c, 6).alias(c) for c in columns]


def channel_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order and gap checks of channels whose sequence is the day, so that it repeats and jumps."""
    rows = views.user_events(spark, sf_dir).withColumn("seq", F.col("day"))
    checked = magnitude.order_checks(rows, DetectorConfig(max_seq_gap=3, max_inter_sample_gap_ms=4 * 86_400_000))
    return checked.groupBy("modality", F.coalesce("reject", F.lit("sound")).alias("reject"), "discontinuous").agg(F.count("*").alias("n_rows"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


def nis_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _reports(views.scenario(spark, sf_dir), DETECTOR, MODS)
    tail = chi2_right("sum_nis", "degrees")
    told = out.withColumn("degrees", F.col("n") * F.col("dof")).withColumn("p_right", F.round(tail, 9))
    return told.select("track_id", "modality", "seq", "n", *_r("sum_nis", "mean_nis"), "p_right", "elevated")


def cusum(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _reports(views.scenario(spark, sf_dir), DETECTOR, MODS)
    return out.select("track_id", "modality", "seq", *_r("cusum_hi", "cusum_lo"), "high", "low")


def captured_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows and CUSUM where huge values come and leave again; such sums are told as huge, without digits."""
    out = _reports(views.captured(spark, sf_dir), SHORT_DETECTOR, MODS).withColumn("huge", F.col("sum_nis") >= views.HUGE)
    mild = [F.round(F.when(F.col(c) < 1e9, F.col(c)), 6).alias(c) for c in ("sum_nis", "cusum_hi", "cusum_lo")]
    return out.select("track_id", "generation", "modality", "seq", "n", "huge", *mild, "elevated", "high", "low")


def exact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Window sums of the capture as whole numbers of 40 bits, the lowest in units of 2^-83, and the doubles nearest to them."""
    sound = magnitude.generations(views.captured(spark, sf_dir), SHORT_DETECTOR, MODS)
    out = exact.window_sums(sound, "nis", magnitude.KEY, "seq", SHORT_DETECTOR.window_len, "sum_nis")
    mild = F.when(F.col("sum_nis") < 1e9, F.round("sum_nis", 6)).alias("sum_nis")
    return out.select("track_id", "generation", "modality", "seq", mild, *(c.alias(n) for n, c in exact.limb_columns(F.col("limbs")).items()))


def refused_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the capture that are no evidence, and why."""
    out = magnitude.rejected(views.captured(spark, sf_dir), SHORT_DETECTOR, MODS)
    return out.select("track_id", "modality", "seq", "timestamp_ms", "dof", F.round(F.when(~F.isnan("nis"), F.col("nis")), 6).alias("nis"), "reject")


def generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = magnitude.generations(views.captured(spark, sf_dir), SHORT_DETECTOR)
    return rows.select("track_id", "modality", "seq", "generation", "is_reset")


def _reports(rows: DataFrame, cfg: DetectorConfig, mods: tuple[str, ...]) -> DataFrame:
    sound = magnitude.generations(rows, cfg, mods)
    return magnitude.channel_reports(magnitude.channel_windows(sound, cfg), cfg, len(mods))


def magnitude_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    reports = _reports(views.captured(spark, sf_dir), SHORT_DETECTOR, MODS)
    out = magnitude.magnitude_verdict(magnitude.frames(reports, MODS), SHORT_DETECTOR, MODS)
    return out.select("track_id", "generation", "seq", F.col("ready").cast("int").alias("ready"), "magnitude_verdict", "magnitude_channels")


def user_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Magnitude over many sparse tracks: verdicts counted by generation."""
    mods = canonical(tuple(views.EVENT_MODALITY.values()))
    reports = _reports(views.user_events(spark, sf_dir), EVENT_DETECTOR, mods)
    out = magnitude.magnitude_verdict(magnitude.frames(reports, mods), EVENT_DETECTOR, mods)
    return out.groupBy("generation", "magnitude_verdict", "magnitude_channels").agg(F.count("*").alias("n_frames"))


def _wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    reports = _reports(views.captured(spark, sf_dir), SHORT_DETECTOR, MODS)
    return magnitude.frames(reports, MODS, fusion.PROVENANCE)


def aligned_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = correlation.aligned(_wide(spark, sf_dir), SHORT_DETECTOR, MODS)
    return out.select("track_id", "generation", "seq", "complete", "projected", F.when(F.col("place").isNotNull(), F.col("suffix")).alias("suffix"), F.col("place").cast("long").alias("place"))


def pair_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = correlation.pair_correlations(correlation.aligned(_wide(spark, sf_dir), SHORT_DETECTOR, MODS), SHORT_CORR.for_axes(views.AXES), MODS)
    names = [f"r_{a}_{i}_{j}" for a in range(views.AXES) for i, j in combinations(range(len(MODS)), 2)]
    return out.filter("w >= 4").select("track_id", "seq", F.col("w").cast("long").alias("w"), *(F.round(F.col(n), 5).alias(n) for n in names))


def correlation_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fusion.assessed_frames(views.scenario(spark, sf_dir), MODS, DETECTOR, CORR)
    return out.select("track_id", "seq", *(c for a in range(views.AXES) for c in (f"corr_{a}", f"mask_{a}")), "consistency", F.col("consistency_mask").cast("int").alias("consistency_mask"))


FUSED = ("track_id", "seq", "magnitude_verdict", "magnitude_channels", "consistency", "consistency_status", "fused_verdict", "fused_channels", "fused_magnitude")


def fused_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: the rolling assessment of every frame of the scenario."""
    return fusion.assessed_frames(views.scenario(spark, sf_dir), MODS, DETECTOR, CORR).select(*FUSED)


def captured_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over a capture with gaps, resets, absent projections and skew."""
    return fusion.assessed_frames(views.captured(spark, sf_dir), MODS, SHORT_DETECTOR, SHORT_CORR).select("generation", *FUSED)


# SQL -----------------------------------------------------------------------


def _list(values: list[float]) -> str:
    return "[" + ", ".join("1e308" if v == float("inf") else repr(v) for v in values) + "]"


#: What a row must have to be evidence at all.
SOUND_SQL = "seq IS NOT NULL AND nis >= 0 AND nis < 'infinity'::DOUBLE"


def generation_sql(cfg: DetectorConfig, modalities: tuple[str, ...] = MODS) -> str:
    """CTEs from obs to ``gen``, the sound rows: each track's frames one after another, with the last admitted row of each channel as state."""
    sent = ",\n  ".join(f"coalesce(list(cand) FILTER (modality = '{m}'), []) AS c_{m}" for m in modalities)

    def cusum(m: str, sign: int, old: str) -> str:
        step = f"p_{m}.nis / sqrt(2.0 * p_{m}.dof) - p_{m}.dof / sqrt(2.0 * p_{m}.dof)"
        kept = f"CASE WHEN jump OR s_{m} IS NULL THEN 0 ELSE {old}_{m} END"
        return f"greatest(0, {kept} {'+' if sign > 0 else '-'} ({step}) - {cfg.cusum_slack!r})"

    def state(m: str) -> str:
        old = lambda c: f"CASE WHEN NOT jump THEN {c}_{m} END"
        return f"""CASE WHEN p_{m} IS NULL THEN {old("s")} ELSE nseq END AS s_{m}, CASE WHEN p_{m} IS NULL THEN {old("t")} ELSE p_{m}.ts END AS t_{m},
  CASE WHEN p_{m} IS NULL THEN {old("d")} ELSE p_{m}.dof END AS d_{m}, p_{m}.rid AS r_{m},
  CASE WHEN p_{m} IS NULL THEN {old("h")} ELSE {cusum(m, 1, "h")} END AS h_{m}, CASE WHEN p_{m} IS NULL THEN {old("l")} ELSE {cusum(m, -1, "l")} END AS l_{m}"""

    nothing = ", ".join(f"NULL::BIGINT AS s_{m}, NULL::BIGINT AS t_{m}, NULL::INT AS d_{m}, NULL::BIGINT AS r_{m}, NULL::DOUBLE AS h_{m}, NULL::DOUBLE AS l_{m}" for m in modalities)
    # The first row of a channel's frame that its state lets pass.
    passed = lambda c, m: f"f.s_{m} IS NULL OR (x.seq > f.s_{m} AND {c}.dof = f.d_{m} AND {c}.ts > f.t_{m})"
    picks = ",\n  ".join(f"list_filter(x.c_{m}, lambda c: {passed('c', m)})[1] AS p_{m}" for m in modalities)
    gap = lambda m: f"(s_{m} IS NOT NULL AND p_{m} IS NOT NULL AND (nseq - s_{m} > {cfg.max_seq_gap} OR p_{m}.ts - t_{m} > {cfg.max_inter_sample_gap_ms}))"
    jump = " OR ".join(f"coalesce({gap(m)}, false)" for m in modalities)
    picked = "CASE r.modality " + " ".join(f"WHEN '{m}' THEN f.r_{m}" for m in modalities) + " END"
    of = lambda c: "CASE r.modality " + " ".join(f"WHEN '{m}' THEN f.{c}_{m}" for m in modalities) + " END"
    return f"""ranked AS (SELECT *, row_number() OVER (PARTITION BY track_id, seq, modality ORDER BY timestamp_ms, dof, nis) AS rid FROM obs WHERE {SOUND_SQL}),
cands AS (SELECT track_id, seq, modality, {{'ts': timestamp_ms, 'dof': dof, 'nis': nis, 'rid': rid}} AS cand FROM ranked ORDER BY rid),
sent AS MATERIALIZED (SELECT track_id, seq, row_number() OVER (PARTITION BY track_id ORDER BY seq) AS k, {", ".join(f"c_{m}" for m in modalities)}
  FROM (SELECT track_id, seq, {sent.replace("list(cand)", "list(cand ORDER BY cand.rid)")} FROM cands GROUP BY track_id, seq)),
fold AS (SELECT DISTINCT track_id, 0::BIGINT AS k, NULL::BIGINT AS seq, 0::BIGINT AS g, false AS jump, {nothing} FROM sent
  UNION ALL SELECT track_id, nk, nseq, g + jump::INT, jump, {", ".join(state(m) for m in modalities)}
  FROM (SELECT *, {jump} AS jump FROM (SELECT f.* EXCLUDE (jump), x.seq AS nseq, x.k AS nk,
  {picks} FROM fold f JOIN sent x ON x.track_id = f.track_id AND x.k = f.k + 1))),
gen AS (SELECT r.*, f.g AS generation, f.jump AS is_reset, {of("h")} AS cusum_hi, {of("l")} AS cusum_lo FROM ranked r JOIN fold f ON r.track_id = f.track_id AND r.seq = f.seq WHERE r.rid = {picked})"""


def reports_sql(cfg: DetectorConfig, channels: int) -> str:
    """CTEs from gen to ``rep``."""
    crit = _list(magnitude.critical_values(cfg, channels, 3))
    return f"""low AS (SELECT *, count(*) OVER w AS n, sum(nis) OVER w AS sum_nis, avg(nis) OVER w AS mean_nis FROM gen
  WINDOW w AS (PARTITION BY track_id, generation, modality ORDER BY seq ROWS {cfg.window_len - 1} PRECEDING)),
flags AS (SELECT *, sum_nis > ({crit})[n + 1] AND dof = 3 AS elevated, cusum_hi >= {cfg.cusum_threshold!r} AS high, cusum_lo >= {cfg.cusum_threshold!r} AS low_alarm, n >= {cfg.min_samples} AS ready FROM low),
rep AS (SELECT *, elevated OR high AS high_anomalous, elevated OR high OR low_alarm AS anomalous FROM flags)"""


def verdict_sql(cfg: DetectorConfig, channels: int) -> str:
    """CTEs from rep to ``mag``: one row a frame."""
    return f"""counts AS (SELECT track_id, generation, seq, count(*) FILTER (ready) AS ready, count(*) FILTER (ready AND high_anomalous) AS high_n, count(*) FILTER (ready AND anomalous) AS some_n, count(*) FILTER (ready AND low_alarm) AS low_n,
  coalesce(max(timestamp_ms) FILTER (ready) - min(timestamp_ms) FILTER (ready), 0) AS span, coalesce(string_agg(modality, ',' ORDER BY code) FILTER (ready AND anomalous), '') AS magnitude_channels,
  coalesce(sum(1 << CASE modality WHEN 'visual' THEN 0 WHEN 'acoustic' THEN 1 ELSE 2 END) FILTER (ready AND anomalous), 0)::INT AS mmask FROM rep GROUP BY track_id, generation, seq),
mag AS (SELECT *, CASE WHEN some_n > 0 AND (NOT full_set OR low_n > 0) THEN 'unclassified' WHEN NOT full_set THEN 'insufficient' WHEN high_n = 0 THEN 'nominal' WHEN high_n >= 2 AND high_n >= {cfg.jam_fraction} * ready THEN 'broad' ELSE 'attributed' END AS magnitude_verdict
  FROM (SELECT *, ready >= {cfg.min_channels} AND ready = {channels} AND span <= {cfg.max_timestamp_skew_ms} AS full_set FROM counts))"""


def frames_sql(cfg: DetectorConfig) -> str:
    """CTEs from gen to ``place``: complete, projected, and the place in the suffix."""
    values = ", ".join(f"max(p{a}) FILTER (modality = '{m}') AS {m}_p{a}" for m in MODS for a in range(views.AXES))
    return f"""fr AS (SELECT track_id, generation, seq, count(*) = {len(MODS)} AS complete, count(*) = {len(MODS)} AND count(p0) = {len(MODS)} AS projected, max(timestamp_ms) - min(timestamp_ms) <= {cfg.max_timestamp_skew_ms} AS coherent, max(context_id) AS context_id,
  max(timestamp_ms) FILTER (modality = 'radar') AS radar_ts, max(timestamp_ms) FILTER (modality = 'visual') AS visual_ts, max(timestamp_ms) FILTER (modality = 'acoustic') AS acoustic_ts, {values} FROM gen GROUP BY track_id, generation, seq),
us AS (SELECT *, projected AND coherent AS usable FROM fr),
br AS (SELECT *, usable AND NOT coalesce(lag(usable) OVER t AND seq - lag(seq) OVER t <= {cfg.max_seq_gap} AND context_id = lag(context_id) OVER t
  AND radar_ts - lag(radar_ts) OVER t <= {cfg.max_inter_sample_gap_ms} AND visual_ts - lag(visual_ts) OVER t <= {cfg.max_inter_sample_gap_ms} AND acoustic_ts - lag(acoustic_ts) OVER t <= {cfg.max_inter_sample_gap_ms}, false) AS begins FROM us WINDOW t AS (PARTITION BY track_id, generation ORDER BY seq)),
sx AS (SELECT *, sum(begins::INT) OVER (PARTITION BY track_id, generation ORDER BY seq)::BIGINT AS sfx FROM br),
place AS (SELECT *, CASE WHEN usable THEN count(*) FILTER (usable) OVER (PARTITION BY track_id, generation, sfx ORDER BY seq) END AS place FROM sx)"""


def pairs_sql(cfg: CorrelationConfig) -> str:
    """CTEs from place to ``pc``: correlations over window frames."""
    r = ", ".join(f"corr({MODS[i]}_p{a}, {MODS[j]}_p{a}) OVER w AS r_{a}_{i}_{j}" for a in range(views.AXES) for i, j in combinations(range(len(MODS)), 2))
    return f"""pc AS (SELECT track_id, generation, seq, place, least(place, {cfg.window}) AS w, {r} FROM place WHERE usable WINDOW w AS (PARTITION BY track_id, generation, sfx ORDER BY seq ROWS {cfg.window - 1} PRECEDING))"""


def axes_sql(cfg: CorrelationConfig) -> str:
    """CTEs from pc and mag to ``fused``; three channels, so a strict majority is two or three of them."""
    floors = _list(cfg.for_axes(views.AXES).floors(3))
    parts = []
    for a in range(views.AXES):
        parts.append(f"""ax{a} AS (SELECT *, greatest(r_{a}_0_1, r_{a}_0_2, r_{a}_1_2) AS ref, greatest({cfg.corr_floor!r}, ({floors})[w + 1], {cfg.decouple_ratio!r} * greatest(r_{a}_0_1, r_{a}_0_2, r_{a}_1_2)) AS thr FROM {"pc" if not a else f"st{a - 1}"}),
ed{a} AS (SELECT *, (r_{a}_0_1 >= thr)::INT + 2 * (r_{a}_0_2 >= thr)::INT + 4 * (r_{a}_1_2 >= thr)::INT AS ed, CASE WHEN w < {cfg.min_samples} OR ref < thr THEN 'insufficient' END AS early FROM ax{a}),
st{a} AS (SELECT * EXCLUDE (ref, thr, ed, early), CASE WHEN early IS NOT NULL THEN early WHEN ed = 7 THEN 'nominal' WHEN ed IN (1, 2, 4) THEN 'decoupled' ELSE 'insufficient' END AS corr_{a},
  CASE WHEN early IS NOT NULL THEN 0 WHEN ed = 1 THEN 4 WHEN ed = 2 THEN 2 WHEN ed = 4 THEN 1 ELSE 0 END AS mask_{a} FROM ed{a})""")
    last = views.AXES - 1
    some = lambda state: " OR ".join(f"corr_{a} = '{state}'" for a in range(views.AXES))
    mask = " | ".join(f"mask_{a}" for a in range(views.AXES))
    differs = " OR ".join(f"(corr_{a} = 'decoupled' AND mask_{a} <> ({mask}))" for a in range(views.AXES))
    return ",\n".join(parts) + f""",
pr AS (SELECT track_id, prior_id, min(seq) AS first_seq FROM gen WHERE prior_id IS NOT NULL AND p0 IS NOT NULL GROUP BY 1, 2),
ru AS (SELECT track_id, min(seq) AS reused_at FROM gen JOIN pr USING (track_id, prior_id) WHERE seq > first_seq AND p0 IS NOT NULL GROUP BY 1),
mr AS (SELECT m.*, coalesce(m.seq >= reused_at, false) AS reused FROM mag m LEFT JOIN ru USING (track_id)),
ev AS (SELECT m.*, {", ".join(f"coalesce(s.corr_{a}, 'insufficient') AS corr_{a}, coalesce(s.mask_{a}, 0) AS mask_{a}" for a in range(views.AXES))},
  CASE WHEN reused THEN 'extraction_error' WHEN s.seq IS NULL THEN 'missing_projection' WHEN {some("insufficient")} THEN 'assessed_insufficient' ELSE 'assessed' END AS consistency_status,
  CASE WHEN reused OR s.seq IS NULL THEN 'insufficient' WHEN ({mask}) <> 0 AND ({differs} OR {some("insufficient")}) THEN 'conflicted' WHEN {some("insufficient")} THEN 'insufficient' WHEN ({mask}) = 0 THEN 'intact' ELSE 'decoupled' END AS consistency,
  CASE WHEN reused OR s.seq IS NULL THEN 0 ELSE ({mask}) END AS cmask FROM mr m LEFT JOIN st{last} s USING (track_id, generation, seq)),
fv AS (SELECT *, CASE WHEN consistency = 'conflicted' OR magnitude_verdict = 'unclassified' THEN 'unclassified' WHEN magnitude_verdict = 'insufficient' AND consistency = 'insufficient' THEN 'insufficient'
  WHEN consistency = 'decoupled' THEN CASE WHEN magnitude_verdict IN ('attributed', 'broad') AND mmask <> cmask THEN 'unclassified' ELSE 'attributed' END
  WHEN magnitude_verdict IN ('broad', 'attributed') THEN magnitude_verdict WHEN magnitude_verdict = 'nominal' AND consistency = 'intact' THEN 'nominal' ELSE 'insufficient' END AS fused_verdict FROM ev),
fm AS (SELECT *, CASE WHEN fused_verdict IN ('unclassified', 'attributed') THEN mmask | cmask ELSE 0 END AS fmask FROM fv),
fused AS (SELECT *, concat_ws(',', CASE WHEN fmask & 1 > 0 THEN 'visual' END, CASE WHEN fmask & 2 > 0 THEN 'acoustic' END, CASE WHEN fmask & 4 > 0 THEN 'radar' END) AS fused_channels,
  CASE WHEN fused_verdict = 'attributed' THEN CASE WHEN consistency <> 'decoupled' THEN 'elevated' WHEN magnitude_verdict = 'insufficient' THEN 'insufficient' WHEN mmask & fmask = 0 THEN 'in_covariance' WHEN mmask & fmask = fmask THEN 'elevated' ELSE 'mixed' END END AS fused_magnitude FROM fm)"""


def assessed_sql(captured: bool) -> str:
    detector, corr = (SHORT_DETECTOR, SHORT_CORR) if captured else (DETECTOR, CORR)
    base = views.captured_sql() if captured else views.scenario_sql()
    return "WITH RECURSIVE " + ",\n".join((base, generation_sql(detector), reports_sql(detector, 3), verdict_sql(detector, 3), frames_sql(detector), pairs_sql(corr), axes_sql(corr)))


def _captured_until(*ctes: str) -> str:
    return "WITH RECURSIVE " + ",\n".join((views.captured_sql(), generation_sql(SHORT_DETECTOR), *ctes))


_SCENARIO_REPORTS = "WITH RECURSIVE " + ",\n".join((views.scenario_sql(), generation_sql(DETECTOR), reports_sql(DETECTOR, 3)))
_EVENT_MODS = canonical(tuple(views.EVENT_MODALITY.values()))
_FUSED_SQL = ", ".join(FUSED)

# Another way than the columns': Poisson terms by their gamma functions for even degrees; for odd ones, less the series of the left tail.
_TERM = "exp((i + {half}) * ln(sum_nis / 2) - sum_nis / 2 - lgamma(i + 1 + {half}))"
_TAIL = f"""round(CASE WHEN (n * dof) % 2 = 0 THEN list_sum(list_transform(range(n * dof // 2), lambda i: {_TERM.format(half="0.0")}))
  ELSE 1 - list_sum(list_transform(range(n * dof // 2, n * dof // 2 + 800), lambda i: {_TERM.format(half="0.5")})) END, 9)"""

QUERIES = {
    "channel_order": channel_order, "nis_windows": nis_windows, "cusum": cusum, "captured_windows": captured_windows, "exact_windows": exact_windows, "refused_rows": refused_rows, "generations": generations, "magnitude_verdicts": magnitude_verdicts, "user_verdicts": user_verdicts,
    "aligned_frames": aligned_frames, "pair_correlations": pair_correlations, "correlation_verdicts": correlation_verdicts, "fused_verdicts": fused_verdicts, "captured_verdicts": captured_verdicts,
}

ORACLES = {
    "channel_order": f"""WITH RECURSIVE {views.user_events_sql()}, l AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY track_id, modality ORDER BY day, timestamp_ms, nis) AS k FROM obs),
j AS (SELECT track_id, modality, k, day, 'sound' AS reject, false AS discontinuous, day AS p, timestamp_ms AS t FROM l WHERE k = 1
  UNION ALL SELECT l.track_id, l.modality, l.k, l.day, CASE WHEN l.day <= p THEN 'sequence_not_increasing' WHEN timestamp_ms <= t THEN 'timestamp_not_increasing' ELSE 'sound' END,
  l.day > p AND timestamp_ms > t AND (l.day - p > 3 OR timestamp_ms - t > 4 * 86400000),
  CASE WHEN l.day > p AND timestamp_ms > t THEN l.day ELSE p END, CASE WHEN l.day > p AND timestamp_ms > t THEN timestamp_ms ELSE t END
  FROM j JOIN l ON l.track_id = j.track_id AND l.modality = j.modality AND l.k = j.k + 1)
SELECT modality, reject, discontinuous, count(*) AS n_rows, min(day) AS first_seq, max(day) AS last_seq FROM j GROUP BY ALL""",
    "nis_windows": f"{_SCENARIO_REPORTS} SELECT track_id, modality, seq, n, round(sum_nis, 6) AS sum_nis, round(mean_nis, 6) AS mean_nis, {_TAIL} AS p_right, elevated FROM rep",
    # the recursion itself, row by row
    "cusum": f"""WITH RECURSIVE {views.scenario_sql()}, x AS MATERIALIZED (SELECT track_id, modality, seq, nis / sqrt(6.0) - 3 / sqrt(6.0) AS d FROM obs),
run AS (SELECT track_id, modality, seq, greatest(0, d - {DETECTOR.cusum_slack!r}) AS hi, greatest(0, -d - {DETECTOR.cusum_slack!r}) AS lo FROM x WHERE seq = 0
  UNION ALL SELECT x.track_id, x.modality, x.seq, greatest(0, r.hi + x.d - {DETECTOR.cusum_slack!r}), greatest(0, r.lo - x.d - {DETECTOR.cusum_slack!r}) FROM run r JOIN x ON x.track_id = r.track_id AND x.modality = r.modality AND x.seq = r.seq + 1)
SELECT track_id, modality, seq, round(hi, 6) AS cusum_hi, round(lo, 6) AS cusum_lo, hi >= {DETECTOR.cusum_threshold!r} AS high, lo >= {DETECTOR.cusum_threshold!r} AS low FROM run""",
    "captured_windows": _captured_until(reports_sql(SHORT_DETECTOR, 3)) + f""" SELECT track_id, generation, modality, seq, n, sum_nis >= {views.HUGE!r} AS huge, round(CASE WHEN sum_nis < 1e9 THEN sum_nis END, 6) AS sum_nis,
  round(CASE WHEN cusum_hi < 1e9 THEN cusum_hi END, 6) AS cusum_hi, round(CASE WHEN cusum_lo < 1e9 THEN cusum_lo END, 6) AS cusum_lo, elevated, high, low_alarm AS low FROM rep""",
    # Whole numbers: the part from 2^-3 up and the part below, each in units that make it whole, summed and put together again.
    "exact_windows": _captured_until("""parts AS (SELECT *, floor(nis * 8)::HUGEINT AS up, ((nis * 8 - floor(nis * 8)) * 2.0 ** 80)::HUGEINT AS down FROM gen),
tot AS (SELECT *, sum(up) OVER w AS ups, sum(down) OVER w AS downs, sum(nis) OVER w AS total FROM parts
  WINDOW w AS (PARTITION BY track_id, generation, modality ORDER BY seq ROWS WIDTH PRECEDING)),
car AS (SELECT *, ups + (downs >> 80) AS high, downs & ((1::HUGEINT << 80) - 1) AS low FROM tot)""".replace("WIDTH", str(SHORT_DETECTOR.window_len - 1)))
    + """ SELECT track_id, generation::BIGINT AS generation, modality, seq, round(CASE WHEN total < 1e9 THEN total END, 6) AS sum_nis,
  (low & 1099511627775)::BIGINT AS limb_0, (low >> 40)::BIGINT AS limb_1, (high & 1099511627775)::BIGINT AS limb_2,
  ((high >> 40) & 1099511627775)::BIGINT AS limb_3, (high >> 80)::BIGINT AS limb_4 FROM car""",
    # Refused are those that the fold didn't pick; why is told from the state before the frame.
    "refused_rows": _captured_until() + """, held AS (SELECT r.*, f.s, f.t, f.d, g.rid AS took FROM ranked r
  JOIN sent x USING (track_id, seq) JOIN (UNPIVOT_HERE) f ON f.track_id = r.track_id AND f.k = x.k - 1 AND f.modality = r.modality
  LEFT JOIN gen g ON g.track_id = r.track_id AND g.seq = r.seq AND g.modality = r.modality)
SELECT track_id, modality, seq, timestamp_ms, dof, round(nis, 6) AS nis, CASE WHEN took < rid OR seq <= s THEN 'sequence_not_increasing' WHEN dof <> d THEN 'dof_changed' ELSE 'timestamp_not_increasing' END AS reject
FROM held WHERE took IS NULL OR took <> rid
UNION ALL SELECT track_id, modality, seq, timestamp_ms, dof, CASE WHEN NOT isnan(nis) THEN round(nis, 6) END, CASE WHEN seq IS NULL OR nis IS NULL THEN 'incomplete' ELSE 'invalid_value' END
FROM obs WHERE NOT coalesce(SOUND_HERE, false)""".replace("SOUND_HERE", SOUND_SQL).replace("UNPIVOT_HERE", " UNION ALL ".join(f"SELECT track_id, k, '{m}' AS modality, s_{m} AS s, t_{m} AS t, d_{m} AS d FROM fold" for m in MODS)),
    "generations": _captured_until() + " SELECT track_id, modality, seq, generation::BIGINT AS generation, is_reset FROM gen",
    "magnitude_verdicts": _captured_until(reports_sql(SHORT_DETECTOR, 3), verdict_sql(SHORT_DETECTOR, 3)) + " SELECT track_id, generation::BIGINT AS generation, seq, ready::INT AS ready, magnitude_verdict, magnitude_channels FROM mag",
    "user_verdicts": "WITH RECURSIVE " + ",\n".join((views.user_events_sql(), generation_sql(EVENT_DETECTOR, _EVENT_MODS), reports_sql(EVENT_DETECTOR, 5), verdict_sql(EVENT_DETECTOR, 5))) + " SELECT generation::BIGINT AS generation, magnitude_verdict, magnitude_channels, count(*) AS n_frames FROM mag GROUP BY ALL",
    "aligned_frames": _captured_until(frames_sql(SHORT_DETECTOR)) + " SELECT track_id, generation::BIGINT AS generation, seq, complete, projected, CASE WHEN usable THEN sfx END AS suffix, place FROM place",
    "pair_correlations": _captured_until(frames_sql(SHORT_DETECTOR), pairs_sql(SHORT_CORR)) + " SELECT track_id, seq, w, " + ", ".join(f"round(r_{a}_{i}_{j}, 5) AS r_{a}_{i}_{j}" for a in range(3) for i, j in combinations(range(3), 2)) + " FROM pc WHERE w >= 4",
    "correlation_verdicts": assessed_sql(False) + " SELECT track_id, seq, corr_0, mask_0, corr_1, mask_1, corr_2, mask_2, consistency, cmask::INT AS consistency_mask FROM (SELECT * EXCLUDE (cmask), CASE WHEN consistency IN ('decoupled', 'conflicted') THEN cmask ELSE 0 END AS cmask FROM ev)",
    "fused_verdicts": assessed_sql(False) + f" SELECT {_FUSED_SQL} FROM fused",
    "captured_verdicts": assessed_sql(True) + f" SELECT generation::BIGINT AS generation, {_FUSED_SQL} FROM fused",
}
