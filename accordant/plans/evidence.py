"""Queries of evidence: metrics by role, gain of paired streams, observations against frozen ledgers, the work of a recorded stream."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from accordant import views
from accordant.functions.special import Z95
from accordant.operators import ledger, metrics, preflight
from accordant.plans import studies
from accordant.plans.detectors import MODS

#: Frames of a mission, and of an assessment's step and window in the estimate of work.
MISSION, STEP, WINDOW = 200, 10, 128


def condition_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metrics of each role's trials; tracks are dealt to calibration and holdout in turn."""
    role = F.when(F.col("track_id") % 2 == 0, "calibration").otherwise("holdout")
    told = metrics.condition_metrics(studies._trials(spark, sf_dir).withColumn("role", role), ["role", "detector"], views.DT_MS, MISSION)
    return told.select("role", "detector", "metric", "eligible", *(F.round(c, 6).alias(c) for c in ("value", "low", "high")))


def paired_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RMS shift of each track's fused innovation between the clean and the spoofed stream, frame by frame; frames of one alone are told."""
    fused = lambda spoofed, name: views.scenario(spark, sf_dir, spoofed).groupBy("track_id", "seq").agg(F.avg("p0").alias(name))
    both = fused(False, "clean").join(fused(True, "spoofed"), ["track_id", "seq"], "full")
    shift = F.col("spoofed") - F.col("clean")
    told = both.groupBy("track_id").agg(F.count(shift).alias("n_frames"), F.count_if(shift.isNull()).alias("n_unpaired"), F.count_if(F.abs(shift) > 1e-12).alias("n_shifted"), F.sqrt(F.avg(shift * shift)).alias("rms_shift"))
    return told.withColumn("rms_shift", F.round("rms_shift", 6))


def frozen_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as observations of orders as frames, counted by the first thing wrong with them."""
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    part, number = F.col("l_partkey"), F.col("l_linenumber")
    modality = F.element_at(F.array(F.lit("visual"), F.lit("acoustic"), F.lit("radar")), (number % 3 + 1).cast("int"))
    seen = line.select(
        F.col("l_orderkey").alias("fusion_seq"), (F.col("l_suppkey") % 4).alias("track_id"), modality.alias("modality"), number.alias("ordinal"),
        (F.col("l_orderkey") + (part % 53 == 0).cast("int")).alias("seq"), (F.col("l_orderkey") * 100 + (part % 37 == 0).cast("int")).alias("timestamp_ms"),
        F.when(part % 5 != 0, F.col("l_quantity")).alias("projection"), F.lit(1).alias("frame_id"), (1 + (part % 31 == 0).cast("int")).alias("context_id"), (F.col("l_orderkey") + 1).alias("prior_id"),
    )
    order = spark.read.parquet(f"{sf_dir}/orders.parquet").filter(F.col("o_custkey") % 29 != 0)
    expected = F.when(F.col("o_custkey") % 7 == 0, F.array(F.lit("visual"), F.lit("radar"))).otherwise(F.array(*map(F.lit, ("visual", "acoustic", "radar"))))
    frames = order.select(F.col("o_orderkey").alias("fusion_seq"), (F.col("o_orderkey") * 100).alias("fusion_timestamp_ms"), expected.alias("expected_modalities"), F.lit(1).alias("frame_id"), F.lit(1).alias("context_id"), (F.col("o_orderkey") + 1).alias("prior_id"))
    frozen = line.filter("l_returnflag <> 'N'").select(F.col("l_orderkey").alias("fusion_seq"), (F.col("l_suppkey") % 4).alias("track_id"))
    told = ledger.frozen_faults(seen, frames, frozen, "ordinal")
    return told.groupBy("modality", F.coalesce("fault", F.lit("sound")).alias("fault")).agg(F.count("*").alias("n_rows"), F.countDistinct("fusion_seq").alias("n_frames"))


def track_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preflight.track_work(views.captured(spark, sf_dir), STEP, WINDOW)


def recorded_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preflight.work(views.captured(spark, sf_dir), STEP, WINDOW)


def _wilson(k: str, n: str) -> str:
    p, z2 = f"({k}::DOUBLE / {n})", f"{Z95 * Z95!r}"
    centre, half = f"(({p} + {z2} / 2 / {n}) / (1 + {z2} / {n}))", f"({Z95!r} * sqrt({p} * (1 - {p}) / {n} + {z2} / 4 / {n} / {n}) / (1 + {z2} / {n}))"
    return f"{p}, greatest(0, {centre} - {half}), least(1, {centre} + {half}), {n}"


def _hoeffding(mean: str, n: str) -> str:
    return f"greatest(0, {mean} - sqrt(ln(2 / 0.05) / (2 * {n}))), least(1, {mean} + sqrt(ln(2 / 0.05) / (2 * {n})))"


_ARL = _hoeffding("(arl0 / longest)", "n").split(", least")
_LONG = {
    "episodes_per_hour": "episodes * 3600000.0 / duration, NULL, NULL, n", "mission_alert": _wilson("mission", "n"), "any_alert": _wilson("alerted", "n"),
    "arl0": f"arl0, longest * {_ARL[0]}, longest * least{_ARL[1]}, n", "arl0_censored": _wilson("(n - alerted)", "n"),
    "abstention": f"ab, {_hoeffding('ab', '(assessments::DOUBLE * assessments / squares)')}, n", "pre_onset": _wilson("(n - calm)", "n"), "detected": _wilson("detected", "calm"),
    "delay_median_frames": "delay_median, NULL, NULL, detected", "delay_p95_ms": f"delay_p95 * {views.DT_MS}, NULL, NULL, detected",
    "attribution_emitted": _wilson("said", "calm"), "attribution_correct": _wilson("good", "said"), "attribution_wrong": _wilson("(said - good)", "said"),
}
_WORK = f"""WITH {views.captured_sql()}, f AS (SELECT track_id, count(DISTINCT seq) AS frames, count(DISTINCT modality) AS channels FROM obs WHERE seq IS NOT NULL GROUP BY track_id),
w AS (SELECT track_id, frames, channels, 2 * ((frames + {STEP - 1}) // {STEP}) AS assessments, (frames + {STEP - 1}) // {STEP} * 3 * (channels * (channels - 1) // 2) * least({WINDOW}, frames) AS products, frames - 1 AS resets FROM f)"""

QUERIES = {"condition_metrics": condition_metrics, "paired_gain": paired_gain, "frozen_observations": frozen_observations, "track_work": track_work, "recorded_work": recorded_work}

ORACLES = {
    "condition_metrics": studies._TRIALS + f""", t AS (SELECT *, CASE WHEN track_id % 2 = 0 THEN 'calibration' ELSE 'holdout' END AS role, pre_onset_alerts = 0 AS quiet FROM trial),
w AS (SELECT role, detector, count(*) AS n, sum(duration_ms)::DOUBLE AS duration, sum(episodes) AS episodes, sum(assessments)::BIGINT AS assessments, sum(assessments * assessments)::DOUBLE AS squares, max(assessments) AS longest, sum(abstentions) / sum(assessments) AS ab,
  avg(coalesce(first_alert, assessments)) AS arl0, count(first_alert) AS alerted, count(*) FILTER (first_alert < {MISSION}) AS mission, count(*) FILTER (quiet) AS calm, count(delay_frames) FILTER (quiet) AS detected, median(delay_frames) FILTER (quiet) AS delay_median,
  quantile_disc(delay_frames, 0.95) FILTER (quiet) AS delay_p95, count(first_attribution_correct) FILTER (quiet) AS said, count(*) FILTER (quiet AND first_attribution_correct) AS good FROM t GROUP BY ALL),
m(role, detector, metric, value, low, high, eligible) AS ({" UNION ALL ".join(f"SELECT role, detector, '{k}', {v} FROM w" for k, v in _LONG.items())})
SELECT role, detector, metric, eligible, round(value, 6)::DOUBLE AS value, round(low, 6)::DOUBLE AS low, round(high, 6)::DOUBLE AS high FROM m WHERE eligible > 0 AND value IS NOT NULL""",
    "paired_gain": f"""WITH {views.scenario_sql()}, d AS (SELECT o.track_id, seq, CASE WHEN seq >= floor(len / 3)
  THEN (o.p0 - {views.SCALE} * ({math.sqrt(views.RHO)!r} * CAST(v[{views.LATENT_AT + 1}] AS DOUBLE) + {math.sqrt(1 - views.RHO)!r} * CAST(v[3 * o.code + 1] AS DOUBLE))) / {len(MODS)} ELSE 0 END AS x
  FROM obs o JOIN vec USING (track_id, seq) WHERE modality = '{views.SPOOFED}')
SELECT track_id, count(*) AS n_frames, 0 AS n_unpaired, count(*) FILTER (abs(x) > 1e-12) AS n_shifted, round(sqrt(avg(x * x)), 6) AS rms_shift FROM d GROUP BY track_id""",
    "frozen_observations": """WITH o AS (SELECT l_orderkey AS k, l_suppkey % 4 AS t, CASE l_linenumber % 3 WHEN 0 THEN 'visual' WHEN 1 THEN 'acoustic' ELSE 'radar' END AS modality, l_partkey AS p,
  row_number() OVER (PARTITION BY l_orderkey, l_suppkey % 4, l_linenumber % 3 ORDER BY l_linenumber, l_partkey % 53 = 0, l_partkey % 37 = 0, CASE WHEN l_partkey % 5 <> 0 THEN l_quantity END NULLS FIRST, l_partkey % 31 = 0) AS nth FROM lineitem),
z AS (SELECT DISTINCT l_orderkey AS k, l_suppkey % 4 AS t FROM lineitem WHERE l_returnflag <> 'N'),
j AS (SELECT o.*, CASE WHEN NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = o.k AND o_custkey % 29 <> 0) THEN 'unknown_frame' WHEN NOT EXISTS (SELECT 1 FROM z WHERE z.k = o.k AND z.t = o.t) THEN 'track_not_frozen'
  WHEN o.modality = 'acoustic' AND EXISTS (SELECT 1 FROM orders WHERE o_orderkey = o.k AND o_custkey % 7 = 0) THEN 'unexpected_modality'
  WHEN nth > 1 THEN 'repeated_observation'
  WHEN p % 53 = 0 OR p % 37 = 0 THEN 'observation_position' WHEN p % 5 <> 0 AND p % 31 = 0 THEN 'projection_provenance' ELSE 'sound' END AS fault FROM o)
SELECT modality, fault, count(*) AS n_rows, count(DISTINCT k) AS n_frames FROM j GROUP BY ALL""",
    "track_work": _WORK + " SELECT * FROM w",
    "recorded_work": _WORK + f""" SELECT count(*) AS tracks, coalesce(sum(frames), 0)::BIGINT AS frames, coalesce(sum(assessments), 0)::BIGINT AS assessments, coalesce(sum(products), 0)::BIGINT AS products, coalesce(sum(resets), 0)::BIGINT AS resets,
CASE WHEN count(*) = 0 THEN 'no_observations' WHEN sum(assessments) > {preflight.MOST_ASSESSMENTS} THEN 'too_many_assessments' WHEN sum(products) > {preflight.MOST_PRODUCTS} THEN 'too_many_products' WHEN sum(resets) > {preflight.MOST_RESETS} THEN 'too_many_resets' END AS fault FROM w""",
}
