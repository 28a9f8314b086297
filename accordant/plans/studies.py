"""Study queries: replay histories, episodes, metrics with intervals, ranks and information."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from accordant import views
from accordant.functions.special import Z95, garwood
from accordant.operators import fusion, statistics, traces
from accordant.plans import detectors
from accordant.plans.detectors import CORR, DETECTOR, MODS, SHORT_CORR, SHORT_DETECTOR


def _captured(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.assessed_frames(views.captured(spark, sf_dir), MODS, SHORT_DETECTOR, SHORT_CORR)


def replay_histories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces.replay_histories(_captured(spark, sf_dir))


def replay_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces.with_suppressed_rest(traces.replay_histories(_captured(spark, sf_dir)), 1)


def alert_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _captured(spark, sf_dir).withColumn("state", traces.alert_state(F.col("fused_verdict")))
    return traces.episode_starts(rows, ["track_id"], "seq", "state").select("track_id", "seq", "state", "starts_episode")


def verdict_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces.label_spans(_captured(spark, sf_dir), ["track_id"], "seq", "fused_verdict").select("track_id", "fused_verdict", "first_seq", "last_seq", "n_frames")


def _trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fusion.assessed_frames(views.scenario(spark, sf_dir), MODS, DETECTOR, CORR)
    onset = F.floor(F.count("*").over(Window.partitionBy("track_id")) / 3)
    both = None
    for detector, verdict, channels in (("magnitude", "magnitude_verdict", "magnitude_channels"), ("fused", "fused_verdict", "fused_channels")):
        named = rows.withColumn("detector", F.lit(detector)).withColumn("state", traces.alert_state(F.col(verdict))).withColumn("onset", onset).withColumn("correct", F.when(F.col(verdict) == "attributed", F.col(channels) == views.SPOOFED))
        part = traces.trial_records(named, ["detector", "track_id"], "seq", "state", F.col("onset"), views.DT_MS, F.col("correct"))
        both = part if both is None else both.unionByName(part)
    return both


def trial_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _trials(spark, sf_dir)


def evidence_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metrics of each detector over its trials, with the intervals that have a closed form."""
    n = F.count("*")
    any_alert = F.count("first_alert")
    low, high = statistics.wilson(F.col("n_alert"), F.col("n_trials"))
    h_low, h_high = statistics.hoeffding(F.col("abstention_fraction"), F.col("assessments"), 0.0, 1.0)
    clean = F.col("pre_onset_alerts") == 0
    out = _trials(spark, sf_dir).groupBy("detector").agg(
        n.alias("n_trials"), any_alert.alias("n_alert"), F.sum("assessments").alias("assessments"), (F.sum("episodes") / (F.sum("duration_ms") / 3.6e6)).alias("alerts_per_hour"), F.avg(F.coalesce("first_alert", "assessments")).alias("arl0"),
        F.avg(F.col("first_alert").isNull().cast("int")).alias("censored_fraction"), (F.sum("abstentions") / F.sum("assessments")).alias("abstention_fraction"), F.avg((F.col("pre_onset_alerts") > 0).cast("int")).alias("pre_onset_probability"),
        F.count_if(clean & F.col("delay_frames").isNotNull()).alias("n_detected"), F.count_if(clean).alias("n_eligible"), F.median(F.when(clean, F.col("delay_frames"))).alias("median_delay"), F.count_if(clean & F.col("first_attribution_correct").isNotNull()).alias("n_attributed"), F.count_if(clean & F.col("first_attribution_correct")).alias("n_correct"),
    )
    rounded = {"alerts_per_hour": "alerts_per_hour", "arl0": "arl0", "censored_fraction": "censored_fraction", "abstention_fraction": "abstention_fraction", "pre_onset_probability": "pre_onset_probability", "median_delay": "median_delay"}
    return out.select("detector", "n_trials", "n_alert", "n_detected", "n_eligible", "n_attributed", "n_correct", *(F.round(F.col(c), 6).alias(k) for k, c in rounded.items()), *(F.round(x, 6).alias(k) for k, x in (("alert_low", low), ("alert_high", high), ("abstention_low", h_low), ("abstention_high", h_high))))


def poisson_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each type a day, with Garwood's exact interval: a constant for each small count, else its chi-square limits by the driver."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    counts = events.groupBy("event_type").agg(F.count("*").alias("n_events"), (F.datediff(F.max("ts"), F.min("ts")) + 1).alias("days"))
    # One row an event type: a handful, whatever the number of events.
    rows = [(r.event_type, r.n_events, r.days, *garwood(r.n_events, r.days)) for r in counts.collect()]
    out = spark.createDataFrame(rows, "event_type string, n_events bigint, days int, low double, high double")
    return out.select("event_type", "n_events", "days", F.round(F.col("n_events") / F.col("days"), 6).alias("rate"), (F.col("low") <= F.col("n_events") / F.col("days")).alias("above_low"), (F.col("high") >= F.col("n_events") / F.col("days")).alias("below_high"))


def auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return statistics.auc(rows, ["l_linenumber"], "l_quantity", F.col("l_returnflag") == "R").select("l_linenumber", "n_pos", "n_neg", F.round("auc", 6).alias("auc"))


def label_information(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return statistics.entropies(rows, "quality", "toxic").select(*(F.round(c, 6).alias(c) for c in ("h_x", "h_y", "h_xy", "mi")))


def toxic_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/labels.parquet").join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang"), "doc_id")
    low, high = statistics.wilson(F.col("k"), F.col("n"))
    return rows.groupBy("lang").agg(F.count("*").alias("n"), F.sum("toxic").alias("k")).select("lang", "n", "k", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


def order_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    picks = {"p95_nearest": statistics.nearest_rank(95), "p10_floor": statistics.floor_rank(0.1), "p10_rounded": statistics.rounded_rank(0.1), "low_median": statistics.lower_median(), "high_median": statistics.upper_median()}
    out = statistics.picked_ranks(rows, ["event_type"], "value", picks)
    return out.select("event_type", "n", *(F.round(k, 6).alias(k) for k in picks))


def fused_innovation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.scenario(spark, sf_dir).groupBy("track_id", "seq").agg(F.round(F.avg("p0"), 6).alias("fused"), F.count("*").alias("n_channels"))


def attacker_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RMS shift of the fused innovation from what it would be with the latent, after the onset."""
    v = views._vectors(spark, sf_dir).filter(F.col("seq") >= F.floor(F.col("_len") / 3))
    clean, spoofed = (views._coordinate(views.CODES[views.SPOOFED], 0, s) for s in (False, True))
    diff = (spoofed - clean) / len(MODS)
    return v.groupBy("track_id").agg(F.count("*").alias("n_frames"), F.round(F.sqrt(F.avg(diff * diff)), 6).alias("rms_shift"))


def detection_delay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames from onset to the first alert of each channel's CUSUM and of the fused verdict, at probes of every 10 frames."""
    rows = _trials(spark, sf_dir)
    return rows.select("detector", "track_id", "delay_frames", F.when(F.col("delay_frames").isNotNull(), F.ceil(F.col("delay_frames") / 10) * 10).alias("probe_delay"))


_SPAN = lambda name, cond: f"count(*) FILTER ({cond}) AS {name}_frames, min(seq) FILTER ({cond}) AS {name}_first, max(seq) FILTER ({cond}) AS {name}_last"
_ALERT = "IN ('attributed', 'broad', 'unclassified')"
_HISTORIES = (
    detectors.assessed_sql(True)
    + f""", rs AS (SELECT track_id, seq, bool_or(is_reset) AS is_reset FROM gen GROUP BY ALL), hist AS (SELECT track_id, count(*) AS frames, {_SPAN("baseline_alarm", f"magnitude_verdict {_ALERT}")}, {_SPAN("baseline_insufficient", "magnitude_verdict = 'insufficient'")}, {_SPAN("alarm", f"fused_verdict {_ALERT}")},
  {_SPAN("insufficient", "fused_verdict = 'insufficient' OR consistency_status <> 'assessed'")}, {_SPAN("reset", "is_reset")}, {_SPAN("missing_projection", "consistency_status = 'missing_projection'")}, {_SPAN("extraction_error", "consistency_status = 'extraction_error'")}, {_SPAN("analysis_error", "false")},
  arg_max(magnitude_verdict, seq) AS terminal_baseline, arg_max(fused_verdict, seq) AS terminal_verdict FROM fused JOIN rs USING (track_id, seq) GROUP BY track_id)"""
)
_STATES = detectors.assessed_sql(True) + f", st AS (SELECT track_id, seq, CASE WHEN fused_verdict {_ALERT} THEN 'alert' ELSE fused_verdict END AS state FROM fused)"
_EPISODES = ", ep AS (SELECT *, state = 'alert' AND coalesce(last_value(CASE WHEN state IN ('alert', 'nominal') THEN state END IGNORE NULLS) OVER (PARTITION BY {by} ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'nominal') <> 'alert' AS starts_episode FROM st)"
_TRIALS = (
    detectors.assessed_sql(False)
    + f""", st AS (SELECT 'magnitude' AS detector, track_id, seq, CASE WHEN magnitude_verdict {_ALERT} THEN 'alert' ELSE magnitude_verdict END AS state, CASE WHEN magnitude_verdict = 'attributed' THEN magnitude_channels = '{views.SPOOFED}' END AS correct, floor(count(*) OVER (PARTITION BY track_id) / 3)::BIGINT AS onset FROM fused
  UNION ALL SELECT 'fused', track_id, seq, CASE WHEN fused_verdict {_ALERT} THEN 'alert' ELSE fused_verdict END, CASE WHEN fused_verdict = 'attributed' THEN fused_channels = '{views.SPOOFED}' END, floor(count(*) OVER (PARTITION BY track_id) / 3)::BIGINT FROM fused)"""
    + _EPISODES.format(by="detector, track_id")
    + f""", trial AS (SELECT detector, track_id, count(*) AS assessments, count(*) FILTER (state = 'insufficient') AS abstentions, count(*) FILTER (starts_episode) AS episodes, min(seq) FILTER (state = 'alert') AS first_alert, count(*) FILTER (state = 'alert' AND seq < onset) AS pre_onset_alerts,
  min(seq - onset) FILTER (state = 'alert' AND seq >= onset) AS delay_frames, arg_min(correct, seq) FILTER (correct IS NOT NULL AND seq >= onset) AS first_attribution_correct, count(*) * {views.DT_MS} AS duration_ms FROM ep GROUP BY ALL)"""
)
_Z2 = f"{Z95 * Z95!r}"


def _wilson_sql(k: str, n: str) -> tuple[str, str]:
    p = f"({k}::DOUBLE / {n})"
    centre, half = f"(({p} + {_Z2} / 2 / {n}) / (1 + {_Z2} / {n}))", f"({Z95!r} * sqrt({p} * (1 - {p}) / {n} + {_Z2} / 4 / {n} / {n}) / (1 + {_Z2} / {n}))"
    return f"round(greatest(0, {centre} - {half}), 6)", f"round(least(1, {centre} + {half}), 6)"


_W = _wilson_sql("n_alert", "n_trials")
_T = _wilson_sql("k", "n")
_HALF = f"sqrt({math.log(2 / 0.05)!r} / (2 * assessments))"

QUERIES = {
    "replay_histories": replay_histories, "replay_report": replay_report, "alert_episodes": alert_episodes, "verdict_spans": verdict_spans, "trial_records": trial_records, "evidence_metrics": evidence_metrics, "poisson_rates": poisson_rates,
    "auc": auc, "label_information": label_information, "toxic_rates": toxic_rates, "order_statistics": order_statistics, "fused_innovation": fused_innovation, "attacker_gain": attacker_gain, "detection_delay": detection_delay,
}

ORACLES = {
    "replay_histories": _HISTORIES + " SELECT * FROM hist",
    "replay_report": _HISTORIES + " SELECT CASE WHEN nr = 1 THEN track_id END AS track_id, count(*) AS tracks, sum(frames)::BIGINT AS frames, count(*) FILTER (alarm_frames > 0) AS alarm_tracks, count(*) FILTER (insufficient_frames > 0) AS insufficient_tracks, sum(alarm_frames)::BIGINT AS alarm_frames, min(alarm_first) AS alarm_first, max(alarm_last) AS alarm_last FROM (SELECT *, row_number() OVER (ORDER BY track_id) AS nr FROM hist) GROUP BY ALL",
    "alert_episodes": _STATES + _EPISODES.format(by="track_id") + " SELECT track_id, seq, state, starts_episode FROM ep",
    "verdict_spans": detectors.assessed_sql(True) + ", a AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY seq) - row_number() OVER (PARTITION BY track_id, fused_verdict ORDER BY seq) AS island FROM fused) SELECT track_id, fused_verdict, min(seq) AS first_seq, max(seq) AS last_seq, count(*) AS n_frames FROM a GROUP BY track_id, fused_verdict, island",
    "trial_records": _TRIALS + " SELECT * FROM trial",
    "evidence_metrics": _TRIALS + f""", m AS (SELECT detector, count(*) AS n_trials, count(first_alert) AS n_alert, sum(assessments)::BIGINT AS assessments, sum(episodes) / (sum(duration_ms) / 3.6e6) AS alerts_per_hour, avg(coalesce(first_alert, assessments)) AS arl0, avg((first_alert IS NULL)::INT) AS censored_fraction,
  sum(abstentions) / sum(assessments) AS abstention_fraction, avg((pre_onset_alerts > 0)::INT) AS pre_onset_probability, count(*) FILTER (pre_onset_alerts = 0 AND delay_frames IS NOT NULL) AS n_detected, count(*) FILTER (pre_onset_alerts = 0) AS n_eligible,
  median(delay_frames) FILTER (pre_onset_alerts = 0) AS median_delay, count(*) FILTER (pre_onset_alerts = 0 AND first_attribution_correct IS NOT NULL) AS n_attributed, count(*) FILTER (pre_onset_alerts = 0 AND first_attribution_correct) AS n_correct FROM trial GROUP BY detector)
SELECT detector, n_trials, n_alert, n_detected, n_eligible, n_attributed, n_correct, round(alerts_per_hour, 6) AS alerts_per_hour, round(arl0, 6) AS arl0, round(censored_fraction, 6) AS censored_fraction, round(abstention_fraction, 6) AS abstention_fraction, round(pre_onset_probability, 6) AS pre_onset_probability, round(median_delay, 6) AS median_delay,
  {_W[0]} AS alert_low, {_W[1]} AS alert_high, round(greatest(0, abstention_fraction - {_HALF}), 6) AS abstention_low, round(least(1, abstention_fraction + {_HALF}), 6) AS abstention_high FROM m""",
    "poisson_rates": "SELECT event_type, count(*) AS n_events, (date_diff('day', min(ts), max(ts)) + 1)::INT AS days, round(count(*) / (date_diff('day', min(ts), max(ts)) + 1), 6) AS rate, true AS above_low, true AS below_high FROM events GROUP BY event_type",
    "auc": "WITH r AS (SELECT l_linenumber, l_returnflag = 'R' AS pos, rank() OVER w + (count(*) OVER (PARTITION BY l_linenumber, l_quantity) - 1) / 2 AS mid FROM lineitem WINDOW w AS (PARTITION BY l_linenumber ORDER BY l_quantity)), s AS (SELECT l_linenumber, count(*) FILTER (pos) AS n_pos, count(*) FILTER (NOT pos) AS n_neg, sum(mid) FILTER (pos) AS ranks FROM r GROUP BY ALL) SELECT l_linenumber, n_pos, n_neg, round((ranks - n_pos * (n_pos + 1) / 2) / (n_pos::DOUBLE * n_neg), 6) AS auc FROM s",
    "label_information": "WITH t AS (SELECT count(*)::DOUBLE AS n FROM labels), h AS (SELECT (SELECT -sum(c / n * log2(c / n)) FROM (SELECT count(*) AS c FROM labels GROUP BY quality), t) AS h_x, (SELECT -sum(c / n * log2(c / n)) FROM (SELECT count(*) AS c FROM labels GROUP BY toxic), t) AS h_y, (SELECT -sum(c / n * log2(c / n)) FROM (SELECT count(*) AS c FROM labels GROUP BY quality, toxic), t) AS h_xy) SELECT round(h_x, 6) AS h_x, round(h_y, 6) AS h_y, round(h_xy, 6) AS h_xy, round(h_x + h_y - h_xy, 6) AS mi FROM h",
    "toxic_rates": f"WITH c AS (SELECT lang, count(*) AS n, sum(toxic)::BIGINT AS k FROM labels JOIN documents USING (doc_id) GROUP BY lang) SELECT lang, n, k, {_T[0]} AS low, {_T[1]} AS high FROM c",
    "order_statistics": "WITH l AS (SELECT event_type, list_sort(list(value)) AS v, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY event_type) SELECT event_type, n, round(v[ceil(n * 95 / 100)::INT], 6) AS p95_nearest, round(v[floor(0.1 * (n - 1))::INT + 1], 6) AS p10_floor, round(v[floor(0.1 * (n - 1) + 0.5)::INT + 1], 6) AS p10_rounded, round(v[(n - 1) // 2 + 1], 6) AS low_median, round(v[n // 2 + 1], 6) AS high_median FROM l",
    "fused_innovation": f"WITH {views.scenario_sql()} SELECT track_id, seq, round(avg(p0), 6) AS fused, count(*) AS n_channels FROM obs GROUP BY ALL",
    "attacker_gain": f"WITH {views.scenario_sql()}, d AS (SELECT o.track_id, (o.p0 - {views.SCALE} * ({math.sqrt(views.RHO)!r} * CAST(v[{views.LATENT_AT + 1}] AS DOUBLE) + {math.sqrt(1 - views.RHO)!r} * CAST(v[3 * o.code + 1] AS DOUBLE))) / 3 AS x FROM obs o JOIN vec USING (track_id, seq) WHERE modality = '{views.SPOOFED}' AND seq >= floor(len / 3)) SELECT track_id, count(*) AS n_frames, round(sqrt(avg(x * x)), 6) AS rms_shift FROM d GROUP BY track_id",
    "detection_delay": _TRIALS + " SELECT detector, track_id, delay_frames, (ceil(delay_frames / 10) * 10)::BIGINT AS probe_delay FROM trial",
}
