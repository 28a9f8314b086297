"""Metrics of a study's trials by condition and role, one row a metric, as aggregates of trial records; acceptance rules over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accordant.operators import statistics

HOUR_MS = 3_600_000


def _share(hits: Column, n: Column) -> tuple[Column, Column, Column, Column]:
    return (F.try_divide(hits, n), *statistics.wilson(hits, n), n)


def condition_metrics(trials: DataFrame, by: list[str], frame_ms: int, mission_frames: int, min_eligible: int = 1) -> DataFrame:
    """One row a (``by``, metric): value, interval and eligible trials; a metric without an eligible trial has no row.

    ``trials`` has what ``traces.trial_records`` gives, one row a trial; nulls
    of ``by`` are a group of their own. Delays and attributions count trials
    without an alert before the onset. Shares have Wilson's interval, the
    abstained share and the run length Hoeffding's; what has fewer than
    ``min_eligible`` trials, rates and delays have none. One exchange: all
    statistics are merged before it, percentiles as counts of their values.
    """
    n, calm = F.count("*"), F.col("pre_onset_alerts") == 0
    delay = F.when(calm, F.col("delay_frames"))
    said = F.when(calm, F.col("first_attribution_correct"))
    run = F.coalesce("first_alert", "assessments")
    wide = trials.groupBy(*by).agg(
        n.alias("n"), F.sum("duration_ms").alias("duration"), F.sum("episodes").alias("episodes"), F.sum("assessments").alias("assessments"),
        F.sum(F.col("assessments") * F.col("assessments")).alias("squares"), F.max("assessments").alias("longest"), F.sum("abstentions").alias("abstentions"),
        F.avg(run).alias("arl0"), F.count_if(F.col("first_alert").isNull()).alias("censored"), F.count_if(F.col("first_alert") < mission_frames).alias("mission"),
        F.count("first_alert").alias("alerted"), F.count_if(~calm).alias("early"), F.count_if(calm).alias("calm"), F.count(delay).alias("detected"),
        F.median(delay).alias("delay_median"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY CASE WHEN pre_onset_alerts = 0 THEN delay_frames END)").alias("delay_p95"),
        F.count(said).alias("said"), F.count_if(said).alias("right"), F.count_if(~said).alias("wrong"),
    )
    c, none = F.col, F.lit(None).cast("double")
    # Weights of trials of differing length: as many independent ones as their squares leave.
    weight = F.try_divide(c("assessments") * c("assessments"), c("squares"))
    abstained = F.try_divide(c("abstentions"), c("assessments"))
    low, high = statistics.hoeffding(c("arl0") / c("longest"), c("n"), 0.0, 1.0)
    told = {
        "episodes_per_hour": (F.try_divide(c("episodes") * HOUR_MS, c("duration")), none, none, c("n")),
        "mission_alert": _share(c("mission"), c("n")),
        "any_alert": _share(c("alerted"), c("n")),
        "arl0": (c("arl0"), low * c("longest"), high * c("longest"), c("n")),
        "arl0_censored": _share(c("censored"), c("n")),
        "abstention": (abstained, *statistics.hoeffding(abstained, weight, 0.0, 1.0), c("n")),
        "pre_onset": _share(c("early"), c("n")),
        "detected": _share(c("detected"), c("calm")),
        "delay_median_frames": (c("delay_median"), none, none, c("detected")),
        "delay_p95_ms": (c("delay_p95") * frame_ms, none, none, c("detected")),
        "attribution_emitted": _share(c("said"), c("calm")),
        "attribution_correct": _share(c("right"), c("said")),
        "attribution_wrong": _share(c("wrong"), c("said")),
    }
    enough = lambda x, k: F.when(k >= min_eligible, x)
    rows = [
        F.struct(F.lit(name).alias("metric"), v.cast("double").alias("value"), enough(a, k).alias("low"), enough(b, k).alias("high"), k.alias("eligible"))
        for name, (v, a, b, k) in told.items()
    ]
    return wide.select(*by, F.explode(F.array(*rows)).alias("m")).select(*by, "m.*").filter("eligible > 0 AND value IS NOT NULL")


def accepted(metrics: DataFrame, rules: DataFrame) -> DataFrame:
    """Each rule (its columns of the key, metric, ``most``) with ``accepted``: the upper bound is there and not above ``most``.

    A rule without its metric isn't met. A metric without an interval is none
    either, as a point doesn't bound. Rules are few and written by hand.
    """
    key = [k for k in rules.columns if k != "most"]
    held = metrics.select(*key, F.col("high").alias("_high"))
    return rules.join(held, key, "left").groupBy(*rules.columns).agg(F.coalesce(F.bool_and(F.col("_high").isNotNull() & (F.col("_high") <= F.col("most"))), F.lit(False)).alias("accepted"))
