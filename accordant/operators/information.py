"""Information layer: KSG mutual information, geometry gate, MI consensus and delete-block confirmation.

Nearest-neighbour estimates have no column form, so each (track, axis) window
is a numpy array in ``applyInPandas``; windows are at most ``MAX_WINDOW``
samples, which bounds a group. The estimator is KSG-1 with the Chebyshev
metric, psi(k) + psi(n) - <psi(nx + 1) + psi(ny + 1)>, neighbours strictly
inside. Block plans come from integer arithmetic and are reproducible; the
observation noise is numpy's, keyed by the same seeds.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from accordant.functions.special import digamma, fnv1a64, mix64, splitmix64
from accordant.schema import CODES, canonical

MAX_WINDOW = 512
NEIGHBOURS = 3


#: Bounds that share an axis's part of the family alpha: links within the consensus, and links to outsiders.
BOUND_GROUPS = 2


@dataclass(frozen=True)
class PidConfig:
    window: int = 128
    min_samples: int = 64
    noise: float = 1e-4
    seed: int = 1
    geom_k: int = 5
    id_max: float = 10.0
    cv_min: float = 0.01
    nn_ratio_max: float = 0.999
    decouple_ratio: float = 0.4
    mi_floor: float = 0.03
    resamples: int = 100
    block: int = 8
    family_alpha: float = 0.10

    def __post_init__(self) -> None:
        if not (NEIGHBOURS + 1 < self.min_samples <= self.window <= MAX_WINDOW):
            raise ValueError(f"min_samples <= window <= {MAX_WINDOW}")
        if not (0 < self.block < self.min_samples and 0 <= self.resamples <= 10_000 and 0 < self.decouple_ratio < 1 and self.mi_floor > 0 and self.noise >= 0 and 0 < self.family_alpha < 1):
            raise ValueError("block, resamples, ratio, floor, noise or alpha is out of range")


_PSI = np.array([0.0] + [digamma(i) for i in range(1, MAX_WINDOW + 2)])


def standardised(x: np.ndarray) -> np.ndarray | None:
    """Zero mean, unit variance; None for a degenerate column."""
    low, high = x.min(), x.max()
    if not (np.isfinite(low) and np.isfinite(high)) or low == high:
        return None
    centre, scale = low / 2 + high / 2, max(abs(low - (low / 2 + high / 2)), abs(high - (low / 2 + high / 2)))
    z = (x - centre) / scale
    z = z - z.mean()
    rms = math.sqrt(float((z * z).mean()))
    return z / rms if rms > np.finfo(float).eps else None


def ksg(x: np.ndarray, y: np.ndarray, k: int = NEIGHBOURS) -> float:
    """Mutual information in nats; small negative estimates are kept."""
    n = len(x)
    dx, dy = np.abs(x[:, None] - x[None, :]), np.abs(y[:, None] - y[None, :])
    joint = np.maximum(dx, dy)
    np.fill_diagonal(joint, np.inf)
    eps = np.partition(joint, k - 1, axis=1)[:, k - 1 : k]
    nx, ny = (dx < eps).sum(1) - 1, (dy < eps).sum(1) - 1
    return float(_PSI[k] + _PSI[n] - (_PSI[nx + 1] + _PSI[ny + 1]).mean())


def local_mi(x: np.ndarray, y: np.ndarray, at: tuple[float, float], k: int = NEIGHBOURS) -> float:
    """Pointwise estimate of a query against reference columns."""
    dx, dy = np.abs(x - at[0]), np.abs(y - at[1])
    eps = np.partition(np.maximum(dx, dy), k - 1)[k - 1]
    return float(_PSI[k] + _PSI[len(x)] - _PSI[int((dx < eps).sum()) + 1] - _PSI[int((dy < eps).sum()) + 1])


def geometry_sound(x: np.ndarray, y: np.ndarray, cfg: PidConfig) -> bool:
    """Intrinsic dimension (maximum likelihood over neighbour distances), spread of distances, and nearest to mean distance."""
    d = np.maximum(np.abs(x[:, None] - x[None, :]), np.abs(y[:, None] - y[None, :]))
    near = np.sort(d, axis=1)[:, 1 : cfg.geom_k + 1]
    if not (near > 0).all():
        return False
    logs = np.log(near[:, -1:] / near[:, :-1]).mean()
    pairs = d[np.triu_indices(len(x), 1)]
    mean = pairs.mean()
    return bool(logs > 0 and 1 / logs <= cfg.id_max and pairs.std() / mean >= cfg.cv_min and near[:, 0].mean() / mean <= cfg.nn_ratio_max)


def domain_seed(seed: int, domain: str, *parts: int) -> int:
    h = mix64(seed ^ fnv1a64(domain.encode()))
    for p in parts:
        h = mix64(h ^ p)
    return h


def delete_block_plans(n: int, block: int, resamples: int, seed: int) -> list[np.ndarray]:
    """Retained rows of each replicate: a circular block is left out, its start from a shuffle of all starts. Each start serves once."""
    if not 0 < block < n:
        raise ValueError("a block is shorter than the window")
    if resamples > n:
        raise ValueError("more resamples than a window has starts")
    starts, state = list(range(n)), seed
    for i in range(n - 1, 0, -1):
        state, r = splitmix64(state)
        j = r % (i + 1)
        starts[i], starts[j] = starts[j], starts[i]
    rows = np.arange(n)
    return [np.sort((starts[b] + block + rows[: n - block]) % n) for b in range(resamples)]


@dataclass(frozen=True)
class PidReport:
    verdict: str  # nominal, decoupled, insufficient
    decoupled: tuple[str, ...]
    reference: float
    threshold: float
    note: str


def consensus(mi: dict[tuple[int, int], float], c: int, threshold: float) -> list[int] | None:
    """The unique clique of a strict majority, if there is one."""
    edge = lambda i, j: mi[min(i, j), max(i, j)] >= threshold
    best: list[list[int]] = []
    for mask in range(1, 1 << c):
        members = [i for i in range(c) if mask >> i & 1]
        if all(edge(i, j) for i, j in combinations(members, 2)):
            if best and len(members) > len(best[0]):
                best = []
            if not best or len(members) == len(best[0]):
                best.append(members)
    return best[0] if len(best) == 1 and 2 * len(best[0]) > c else None


def analyse(columns: dict[str, np.ndarray], cfg: PidConfig, axis: int = 0, axes: int = 1) -> PidReport:
    """MI consensus of a window. A pair that fails leaves no evidence; an accusation must survive delete-block resampling."""
    mods = canonical(tuple(columns))
    c = len(mods)
    n = min((len(v) for v in columns.values()), default=0)
    none = lambda why, ref=math.nan, thr=math.nan: PidReport("insufficient", (), ref, thr, why)
    if c < 3 or n < cfg.min_samples:
        return none("too few channels or samples")
    w = min(n, cfg.window)
    cols = []
    for m in mods:
        z = standardised(np.asarray(columns[m][-w:], float))
        if z is None:
            return none(f"{m} is constant")
        rng = np.random.default_rng(domain_seed(cfg.seed, "noise", axis, CODES[m]))
        cols.append(z + cfg.noise * rng.standard_normal(w))
    pairs = list(combinations(range(c), 2))
    if not all(geometry_sound(cols[i], cols[j], cfg) for i, j in pairs):
        return none("geometry gate")

    def margins(rows: np.ndarray | slice) -> tuple[dict, float, float]:
        mi = {(i, j): ksg(cols[i][rows], cols[j][rows]) for i, j in pairs}
        ref = max(mi.values())
        return mi, ref, max(cfg.mi_floor, cfg.decouple_ratio * ref)

    mi, ref, threshold = margins(slice(None))
    if ref < cfg.mi_floor:
        return none("no coherent consensus", ref, threshold)
    members = consensus(mi, c, threshold)
    if members is None:
        return none("ambiguous consensus", ref, threshold)
    outside = [i for i in range(c) if i not in members]
    if any(mi[min(i, j), max(i, j)] >= threshold for i in outside for j in members):
        return none("an outsider reaches a member", ref, threshold)
    if not outside:
        return PidReport("nominal", (), ref, threshold, "one clique")
    if cfg.resamples > w:
        return none("more resamples than the window has starts", ref, threshold)
    if cfg.resamples:
        plans = delete_block_plans(w, cfg.block, cfg.resamples, domain_seed(cfg.seed, "blocks", axis))
        worst = []
        for rows in plans:
            again, _, thr = margins(rows)
            held = min(again[p] - thr for p in combinations(members, 2))
            low = min(thr - again[min(i, j), max(i, j)] for i in outside for j in members)
            worst.append(min(held, low))
        # One-sided: the share of replicates that contradict the attribution is at most alpha, shared by the axes and two groups of bounds.
        if sum(x <= 0 for x in worst) > cfg.family_alpha / (axes * BOUND_GROUPS) * len(worst):
            return none("resampling contradicts the attribution", ref, threshold)
    return PidReport("decoupled", tuple(mods[i] for i in outside), ref, threshold, "decoupled")


def pid_reports(frames: DataFrame, modalities: tuple[str, ...], cfg: PidConfig | None = None, axes: int = 3) -> DataFrame:
    """One row a (track_id, axis): the analysis of the track's newest suffix of aligned frames (of ``correlation.aligned``).

    Only the last ``window`` frames of the newest suffix reach a group.
    """
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    cfg, mods = cfg or PidConfig(), canonical(modalities)
    track = Window.partitionBy("track_id")
    newest = frames.withColumn("_g", F.max("generation").over(track)).filter(F.col("generation") == F.col("_g"))
    newest = newest.withColumn("_last", F.max("seq").over(track)).withColumn("_s", F.max("suffix").over(track)).withColumn("_n", F.max(F.when((F.col("suffix") == F.col("_s")) & (F.col("seq") == F.col("_last")), F.col("place"))).over(track))
    tail = newest.filter((F.col("suffix") == F.col("_s")) & (F.col("place") > F.col("_n") - cfg.window))
    long = tail.select("track_id", "seq", F.explode(F.array(*(F.struct(F.lit(a).alias("axis"), *(F.col(f"{m}_p{a}").alias(m) for m in mods)) for a in range(axes)))).alias("x")).select("track_id", "seq", "x.*")

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        r = analyse({m: pdf[m].to_numpy(float) for m in mods}, cfg, int(key[1]), axes)
        return pd.DataFrame({"track_id": [key[0]], "axis": [key[1]], "n": [len(pdf)], "pid_verdict": [r.verdict], "pid_channels": [",".join(r.decoupled)], "reference": [r.reference], "threshold": [r.threshold], "note": [r.note]})

    return long.groupBy("track_id", "axis").applyInPandas(run, "track_id bigint, axis int, n bigint, pid_verdict string, pid_channels string, reference double, threshold double, note string")


def xor_atoms_bits(p: dict[tuple[int, int, int], float]) -> dict[str, float]:
    """Shared-exclusions atoms (two sources, one target) of a discrete distribution {(x, y, t): probability}, in bits.

    The shared part is the average over outcomes of the information that
    "x or y is as observed" gives about the target; the others follow by
    Moebius inversion.
    """
    def mass(holds) -> float:  # noqa: ANN001
        return math.fsum(q for k, q in p.items() if holds(k))

    red = ix = iy = ixy = 0.0
    for (x, y, t), q in p.items():
        if q <= 0:
            continue
        pt = mass(lambda k, t=t: k[2] == t)
        def info(holds, q=q, pt=pt, t=t) -> float:  # noqa: ANN001
            return math.log2(mass(lambda k: holds(k) and k[2] == t) / (mass(holds) * pt))

        red += q * info(lambda k, x=x, y=y: k[0] == x or k[1] == y)
        ix += q * info(lambda k, x=x: k[0] == x)
        iy += q * info(lambda k, y=y: k[1] == y)
        ixy += q * info(lambda k, x=x, y=y: k[0] == x and k[1] == y)
    return {"redundancy": red, "unique_x": ix - red, "unique_y": iy - red, "synergy": ixy - ix - iy + red, "joint": ixy}
