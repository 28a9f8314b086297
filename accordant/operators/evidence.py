"""The streaming evidence study: seeded synthetic tracks under several conditions, assessed in one pass, and metrics with intervals.

All trials of all conditions are tracks of one DataFrame: one plan assesses
them. The AR(1) latents are a true recursion, so each trial is generated by
numpy in its own group. Seeds, track ids and thinning are exact integer
arithmetic; the normal variates are numpy's. Resampling is of whole tracks,
over trial records only (a row a trial and detector).
"""

from __future__ import annotations

import math
import struct
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from accordant.config import CorrelationConfig, DetectorConfig
from accordant.functions.special import envelope, fnv1a64, floor_percentile, garwood, hoeffding, median, mix64, nearest_rank, wilson
from accordant.operators import fusion, traces
from accordant.schema import CODES, MAX_SAFE_INTEGER

MODALITIES = ("visual", "acoustic", "radar")
TARGET = "acoustic"
_MASK = (1 << 64) - 1
#: Domains of seeds by role (fixed values).
ROLES = {"calibration": 0xCA11BA7E00000001, "holdout": 0xC1EA110D00000002}


@dataclass(frozen=True)
class Condition:
    id: str
    phi: float = 0.0
    covariance_scale: float = 1.0
    missing: float = 0.0
    perturbation: str = "none"  # loud, stealthy, broad, missing_projection, invalid_provenance

    @property
    def kind(self) -> str:
        if self.perturbation in ("loud", "stealthy", "broad"):
            return "attack"
        return "clean" if self.perturbation == "none" else "provenance"


@dataclass(frozen=True)
class StudyConfig:
    base_seed: int = 6840335614489011713
    tracks: int = 24
    frames: int = 3_600
    dt_ms: int = 100
    step: int = 10
    onset: int = 1_800
    mission_frames: int = 3_600
    rho: float = 0.7
    sigma: float = 1.0
    bias: float = 6.0
    missing: float = 0.15
    phis: tuple[float, ...] = (0.0, 0.5, 0.85)
    scales: tuple[float, ...] = (0.7, 1.3)
    resamples: int = 500
    min_eligible: int = 8
    detector: DetectorConfig = field(default_factory=DetectorConfig)
    correlation: CorrelationConfig = field(default_factory=CorrelationConfig)

    def __post_init__(self) -> None:
        if not (0 < self.step <= self.frames and 0 <= self.onset < self.frames and self.tracks >= 1 and 0 <= self.rho < 1 and self.sigma > 0 and all(0 <= p < 1 for p in self.phis) and self.resamples >= 0):
            raise ValueError("the study's sizes or parameters are out of range")
        if self.tracks * self.frames * len(self.conditions()) * len(MODALITIES) > 25_000_000:
            raise ValueError("the study has more than 25,000,000 observations")

    def conditions(self) -> list[Condition]:
        clean = [Condition(f"clean_autocorrelation_phi_{float_id(p)}", phi=p) for p in self.phis] + [Condition(f"clean_covariance_scale_{float_id(x)}", covariance_scale=x) for x in self.scales] + [Condition("clean_ordinary_missingness", missing=self.missing)]
        changed = (("attack_loud_acoustic", "loud"), ("attack_stealthy_acoustic", "stealthy"), ("attack_broad_degradation", "broad"), ("provenance_missing_projection", "missing_projection"), ("provenance_invalid_prior", "invalid_provenance"))
        return clean + [Condition(i, perturbation=p) for i, p in changed]


def float_id(x: float) -> str:
    """Six decimals and the bits: names, and so seeds, tell any two values apart."""
    return f"{x:.6f}".replace(".", "p") + f"_{struct.unpack('>Q', struct.pack('>d', x))[0]:016x}"


def trial_seed(cfg: StudyConfig, condition: str, role: str, trial: int) -> int:
    return mix64(cfg.base_seed ^ fnv1a64(condition.encode()) ^ ROLES[role] ^ (trial * 0x9E3779B97F4A7C15 & _MASK))


def track_id(seed: int) -> int:
    return mix64(seed ^ 0x7A6B1D3E51C94F02) % MAX_SAFE_INTEGER + 1


def is_missing(seed: int, frame: int, modality: str, probability: float) -> bool:
    if probability <= 0 or modality != TARGET:
        return False
    bits = mix64(seed ^ (frame * 0xD1B54A32D192ED03 & _MASK) ^ CODES[modality])
    return (bits >> 11) / (1 << 53) < probability


OBSERVED = "track_id bigint, seq bigint, timestamp_ms bigint, modality string, code int, nis double, dof int, p0 double, p1 double, p2 double, frame_id bigint, context_id bigint, prior_id bigint"


def stream(cfg: StudyConfig, c: Condition, seed: int) -> pd.DataFrame:
    """The observations of one trial."""
    rng = np.random.default_rng(seed)
    m = len(MODALITIES)
    noise = rng.standard_normal((cfg.frames, 2 + m, 3))
    latent = np.empty_like(noise)
    latent[0] = noise[0]
    fresh = math.sqrt(1 - c.phi * c.phi)
    for t in range(1, cfg.frames):
        latent[t] = c.phi * latent[t - 1] + fresh * noise[t]
    after = np.arange(cfg.frames) >= cfg.onset
    variance = cfg.sigma**2 * c.covariance_scale
    id_ = track_id(seed)
    seq = np.arange(cfg.frames)
    parts = []
    for i, name in enumerate(MODALITIES):
        shared = latent[:, 0].copy()
        if c.perturbation == "stealthy" and name == TARGET:
            shared[after] = latent[after, 1]
        y = cfg.sigma * (math.sqrt(cfg.rho) * shared + math.sqrt(1 - cfg.rho) * latent[:, 2 + i])
        if c.perturbation == "broad" or (c.perturbation == "loud" and name == TARGET):
            y[after, 0] += cfg.bias * cfg.sigma
        prior = seq + (1_000_000 if c.perturbation == "invalid_provenance" and name == TARGET else 1)
        part = pd.DataFrame({"track_id": id_, "seq": seq, "timestamp_ms": seq * cfg.dt_ms, "modality": name, "code": CODES[name], "nis": (y * y).sum(1) / variance, "dof": 3, "p0": y[:, 0], "p1": y[:, 1], "p2": y[:, 2], "frame_id": 1, "context_id": 1, "prior_id": prior})
        if c.perturbation == "missing_projection":
            part = part.astype({k: "object" for k in ("frame_id", "context_id", "prior_id")})
            part[["p0", "p1", "p2"]] = np.nan
            part[["p0", "p1", "p2", "frame_id", "context_id", "prior_id"]] = None
        if c.missing:
            part = part[[not is_missing(seed, t, name, c.missing) for t in range(cfg.frames)]]
        parts.append(part)
    return pd.concat(parts)


def trials(spark: SparkSession, cfg: StudyConfig, role: str = "holdout") -> DataFrame:
    """condition, trial, track_id and seed (as a decimal string) of every trial."""
    rows = [(c.id, t, track_id(s), str(s)) for c in cfg.conditions() for t in range(cfg.tracks) for s in [trial_seed(cfg, c.id, role, t)]]
    return spark.createDataFrame(rows, "condition string, trial int, track_id bigint, seed string")


def observations(spark: SparkSession, cfg: StudyConfig, role: str = "holdout") -> DataFrame:
    known = {c.id: c for c in cfg.conditions()}
    todo = trials(spark, cfg, role)
    make = lambda pdf: pd.concat([stream(cfg, known[r.condition], int(r.seed)) for r in pdf.itertuples()])
    return todo.groupBy("track_id").applyInPandas(make, OBSERVED)


def records(spark: SparkSession, cfg: StudyConfig, role: str = "holdout") -> DataFrame:
    """One row a (condition, trial, detector): what the metrics need."""
    assessed = fusion.assessed_frames(observations(spark, cfg, role), MODALITIES, cfg.detector, cfg.correlation)
    place = F.row_number().over(Window.partitionBy("track_id").orderBy("seq")) - 1
    frames = assessed.withColumn("frame", place).filter((F.col("frame") + 1) % cfg.step == 0)
    refused = F.col("consistency_status").isin("extraction_error", "analysis_error")
    views = {"magnitude": ("magnitude_verdict", "magnitude_channels", F.lit(False), cfg.detector.min_samples), "fused": ("fused_verdict", "fused_channels", refused, max(cfg.detector.min_samples, cfg.correlation.min_samples))}
    out = None
    for name, (verdict, channels, rejected, samples) in views.items():
        start = -(-samples // cfg.step) * cfg.step - 1
        rows = frames.withColumn("state", F.when(rejected, "rejected").otherwise(traces.alert_state(F.col(verdict)))).withColumn("_attributed", F.when(~rejected & (F.col(verdict) == "attributed"), F.col(channels)))
        told = traces.episode_starts(rows, ["track_id"], "frame", "state")
        alert, begins, late = F.col("state") == "alert", F.col("starts_episode"), F.col("frame") >= cfg.onset
        missing = F.col("state").isin("insufficient", "rejected")
        part = told.groupBy("track_id").agg(
            F.count("*").alias("assessments"), F.count_if(begins).alias("episodes"), F.max(alert & (F.col("frame") < cfg.mission_frames)).alias("mission_alert"), ((F.min(F.when(begins, F.col("frame"))) + 1) / cfg.step).alias("first_alert"),
            F.count_if(F.col("frame") >= start).alias("monitored"), F.count_if((F.col("frame") >= start) & missing).alias("abstained"), F.coalesce(F.max(begins & ~late), F.lit(False)).alias("pre_onset"), (F.min(F.when(begins & late, F.col("frame"))) - cfg.onset).alias("delay"),
            F.min_by("_attributed", F.when(F.col("_attributed").isNotNull() & late, F.col("frame"))).alias("attributed"), ((F.max("seq") - F.min("seq")) * cfg.dt_ms).alias("duration_ms"),
        ).withColumn("detector", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out.join(F.broadcast(trials(spark, cfg, role)), "track_id")


def _rates(r: pd.DataFrame, kind: str) -> dict[str, tuple[float | None, int]]:
    """Point value and number of eligible tracks of each metric that applies to the kind of condition."""
    n = len(r)
    share = lambda x: (float(np.mean(x)), len(x)) if len(x) else (None, 0)
    out = {"abstention": (float(r.abstained.sum() / r.monitored.sum()) if r.monitored.sum() else None, n)}
    if kind == "clean":
        hours = r.duration_ms.sum() / 3.6e6
        out |= {"episodes_per_hour": (r.episodes.sum() / hours if hours else None, n), "mission_alert": share(r.mission_alert), "arl0": share(r.first_alert.fillna(r.assessments)), "arl0_censored": share(r.first_alert.isna())}
    elif kind == "provenance":
        out["any_alert"] = share(r.episodes > 0)
    else:
        calm = r[~r.pre_onset.astype(bool)]
        delays = calm.delay.dropna().tolist()
        out |= {"pre_onset": share(r.pre_onset), "detected": share(calm.delay.notna()), "delay_frames": (median(delays), len(delays)), "delay_p95_frames": (nearest_rank(delays, 0.95), len(delays))}
        said = calm.attributed.dropna()
        out |= {"attribution_emitted": share(calm.attributed.notna()), "attribution_correct": share(said == TARGET)}
    return out


def metrics(found: pd.DataFrame, cfg: StudyConfig) -> pd.DataFrame:
    """One row a (condition, detector, metric): value, interval (none where too few tracks are eligible) and its kind.

    ``found`` has a row a trial and detector, so this is small whatever the
    tracks' length. Proportions have Wilson's interval, rates Garwood's and
    bounded means Hoeffding's; the last two are widened to what resampling of
    whole tracks gives, where at least four fifths of the resamples are usable.
    """
    kinds = {c.id: c.kind for c in cfg.conditions()}
    out = []
    for (condition, detector), r in found.groupby(["condition", "detector"]):
        kind = kinds[condition]
        point = _rates(r, kind)
        rng = np.random.default_rng(mix64(cfg.base_seed ^ fnv1a64(f"{condition}/{detector}".encode())))
        again: dict[str, list[float]] = {k: [] for k in point}
        for _ in range(cfg.resamples):
            for k, (v, _) in _rates(r.iloc[rng.integers(0, len(r), len(r))], kind).items():
                if v is not None:
                    again[k].append(v)
        for name, (value, eligible) in point.items():
            if value is None:
                continue
            boot = (floor_percentile(again[name], 0.025), floor_percentile(again[name], 0.975)) if cfg.resamples and len(again[name]) >= 0.8 * cfg.resamples else None
            if name == "episodes_per_hour":
                own = garwood(int(r.episodes.sum()), r.duration_ms.sum() / 3.6e6)
            elif name == "arl0":
                own = hoeffding(value, len(r), 0.0, float(r.assessments.max()))
            elif name == "abstention":
                own = hoeffding(value, float(r.monitored.sum()) ** 2 / float((r.monitored**2).sum()), 0.0, 1.0)
            elif name.startswith("delay"):
                own = boot
            else:
                own = wilson(value * eligible, eligible)
            low, high = (None, None) if eligible < cfg.min_eligible or own is None else envelope(own, boot) if boot else own
            out.append((condition, detector, name, float(value), low, high, int(eligible)))
    return pd.DataFrame(out, columns=["condition", "detector", "metric", "value", "low", "high", "eligible"])


def accepted(table: pd.DataFrame, most_episodes_per_hour: float = 0.10, condition: str = f"clean_autocorrelation_phi_{float_id(0.0)}") -> bool:
    """The acceptance rule: the upper bound of false-alert episodes an hour under a clean null."""
    rows = table[(table.condition == condition) & (table.metric == "episodes_per_hour")]
    return bool(len(rows) and rows.high.notna().all() and (rows.high <= most_episodes_per_hour).all())
