"""Canonical studies of when information helps over correlation: coupling, parity and autocorrelated nulls.

Each trial is a row that a group generates and scores; scores of all trials
then go through ordinary aggregates (AUC, rates, Wilson intervals).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from accordant.functions.special import bartlett_n_eff, fnv1a64, mix64, normal_quantile
from accordant.operators import statistics
from accordant.operators.information import MAX_WINDOW, domain_seed, ksg

PHIS = (0.0, 0.3, 0.6, 0.9)
NULL_WINDOW = 128
SIGMA = 0.5


def _rng(seed: int, study: str, trial: int, positive: bool) -> np.random.Generator:
    return np.random.default_rng(domain_seed(seed, study, trial, int(positive)))


def coupled(kind: str, n: int, positive: bool, rng: np.random.Generator, sigma: float = SIGMA) -> tuple[np.ndarray, np.ndarray]:
    """Linear: y = x + noise. Nonlinear: a random sign hides it from correlation. Without coupling x is drawn anew."""
    x = rng.standard_normal(n)
    base = x if positive else rng.standard_normal(n)
    sign = rng.choice([-1.0, 1.0], n) if kind == "nonlinear" else 1.0
    return x, base * sign + sigma * rng.standard_normal(n)


def ar1(n: int, phi: float, rng: np.random.Generator) -> np.ndarray:
    e = rng.standard_normal(n)
    out = np.empty(n)
    out[0] = e[0]
    for t in range(1, n):
        out[t] = phi * out[t - 1] + math.sqrt(1 - phi * phi) * e[t]
    return out


def joint_ksg(a: np.ndarray, b: np.ndarray, t: np.ndarray, k: int = 3) -> float:
    """Mutual information of (a, b) with t, by the same estimator with the first margin in two dimensions."""
    from accordant.operators.information import _PSI

    n = len(a)
    dab = np.maximum(np.abs(a[:, None] - a[None, :]), np.abs(b[:, None] - b[None, :]))
    dt = np.abs(t[:, None] - t[None, :])
    joint = np.maximum(dab, dt)
    np.fill_diagonal(joint, np.inf)
    eps = np.partition(joint, k - 1, axis=1)[:, k - 1 : k]
    nab, nt = (dab < eps).sum(1) - 1, (dt < eps).sum(1) - 1
    return float(_PSI[k] + _PSI[n] - (_PSI[nab + 1] + _PSI[nt + 1]).mean())


def _trials(spark: SparkSession, studies: tuple[str, ...], trials: int) -> DataFrame:
    rows = [(s, t, p) for s in studies for t in range(trials) for p in (False, True)]
    return spark.createDataFrame(rows, "study string, trial int, positive boolean").repartition("study", "trial")


def coupling_scores(spark: SparkSession, trials: int = 20, n: int = 400, seed: int = 7) -> DataFrame:
    """study (linear, nonlinear), trial, positive, rho (absolute) and mi."""
    if not 8 <= n <= MAX_WINDOW:
        raise ValueError(f"n is 8 to {MAX_WINDOW}")

    def run(batches):  # noqa: ANN001, ANN202
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                x, y = coupled(r.study, n, bool(r.positive), _rng(seed, r.study, r.trial, bool(r.positive)))
                out.append((r.study, r.trial, r.positive, abs(float(np.corrcoef(x, y)[0, 1])), ksg(x, y)))
            yield pd.DataFrame(out, columns=["study", "trial", "positive", "rho", "mi"])

    return _trials(spark, ("linear", "nonlinear"), trials).mapInPandas(run, "study string, trial int, positive boolean, rho double, mi double")


def parity_scores(spark: SparkSession, trials: int = 20, n: int = 500, seed: int = 7) -> DataFrame:
    """Sign parity: t follows sign(a b); rho and pairwise are the best single source's, joint that of both."""
    def run(batches):  # noqa: ANN001, ANN202
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                rng = _rng(seed, "parity", r.trial, bool(r.positive))
                a, b = rng.standard_normal((2, n))
                t = np.sign(a * b) * np.abs(rng.standard_normal(n)) if r.positive else rng.standard_normal(n)
                rho = max(abs(float(np.corrcoef(s, t)[0, 1])) for s in (a, b))
                out.append((r.study, r.trial, r.positive, rho, max(ksg(a, t), ksg(b, t)), joint_ksg(a, b, t)))
            yield pd.DataFrame(out, columns=["study", "trial", "positive", "rho", "pairwise", "joint"])

    return _trials(spark, ("parity",), trials).mapInPandas(run, "study string, trial int, positive boolean, rho double, pairwise double, joint double")


def score_aucs(scores: DataFrame, measures: tuple[str, ...]) -> DataFrame:
    """One row a (study, measure): AUC of coupled over uncoupled trials and the mean over coupled ones."""
    long = scores.select("study", "positive", F.explode(F.array(*(F.struct(F.lit(m).alias("measure"), F.col(m).alias("score")) for m in measures))).alias("s")).select("study", "positive", "s.*")
    means = long.filter("positive").groupBy("study", "measure").agg(F.avg("score").alias("mean"))
    return statistics.auc(long, ["study", "measure"], "score", F.col("positive")).join(means, ["study", "measure"])


def null_rates(spark: SparkSession, trials: int = 1_000, seed: int = 7) -> DataFrame:
    """False-positive rates of Fisher's floor on independent AR(1) pairs, with the window's and with Bartlett's sample size; Wilson intervals."""
    z = {a: normal_quantile(1 - a) for a in (0.05, 0.01)}
    floor = lambda q, m: math.tanh(q / math.sqrt(m - 3))

    def run(batches):  # noqa: ANN001, ANN202
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                rng = np.random.default_rng(mix64(seed ^ fnv1a64(b"null") ^ mix64(r.trial * 31 + int(r.phi * 1000))))
                x, y = ar1(NULL_WINDOW, r.phi, rng), ar1(NULL_WINDOW, r.phi, rng)
                out.append((r.phi, r.trial, float(np.corrcoef(x, y)[0, 1])))
            yield pd.DataFrame(out, columns=["phi", "trial", "rho"])

    todo = spark.range(trials).select(F.explode(F.array(*map(F.lit, PHIS))).alias("phi"), F.col("id").cast("int").alias("trial"))
    rho = todo.mapInPandas(run, "phi double, trial int, rho double")
    n_eff = F.lit(float(NULL_WINDOW)) * (1 - F.col("phi") * F.col("phi")) / (1 + F.col("phi") * F.col("phi"))
    parts = [F.struct(F.lit(a).alias("alpha"), F.lit(how).alias("floor"), (F.col("rho") >= (F.lit(floor(q, NULL_WINDOW)) if how == "naive" else F.tanh(q / F.sqrt(n_eff - 3)))).alias("hit")) for a, q in z.items() for how in ("naive", "bartlett")]
    counts = rho.select("phi", F.explode(F.array(*parts)).alias("p")).groupBy("phi", "p.alpha", "p.floor").agg(F.count("*").alias("n"), F.count_if(F.col("p.hit")).alias("k"))
    low, high = statistics.wilson(F.col("k"), F.col("n"))
    return counts.select("phi", "alpha", "floor", "n", "k", (F.col("k") / F.col("n")).alias("rate"), low.alias("low"), high.alias("high"))


def n_eff(phi: float) -> float:
    return bartlett_n_eff(NULL_WINDOW, phi)


#: The slack of the sequential sums.
SEQ_SLACK = 0.25


def pointwise_gaussian_mi(a: Column, b: Column, r: Column) -> Column:
    """Of standard values at correlation ``r``: the log ratio of the coupled to the independent Gaussian density, in nats."""
    rest = 1.0 - r * r
    told = -0.5 * F.ln(rest) - (r * r * (a * a + b * b) - 2.0 * r * a * b) / (2.0 * rest)
    return F.when(rest <= 0.0, 0.0).otherwise(told)


def sequential_cusums(pairs: DataFrame, reference: Column, slack: float = SEQ_SLACK) -> DataFrame:
    """Rows (track_id, seq, x, y): of those after the reference, the sums S = max(0, S + (mean - stat) / sd - slack) of two statistics.

    ``reference`` tells each track's rows that calibrate: means and deviations
    of x, y, their product and their pointwise information are taken from these
    and kept. A low statistic is what decoupling gives, so sums grow with it.
    """
    rows = pairs.withColumn("_cal", reference)
    only = lambda c: F.when(F.col("_cal"), F.col(c))
    whole = Window.partitionBy("track_id")
    spread = lambda c: F.greatest(F.stddev_pop(only(c)).over(whole), F.lit(1e-12))
    for c in ("x", "y"):
        rows = rows.withColumns({f"_m{c}": F.avg(only(c)).over(whole), f"_s{c}": spread(c)})
        rows = rows.withColumn(f"_z{c}", (F.col(c) - F.col(f"_m{c}")) / F.col(f"_s{c}"))
    rows = rows.withColumn("_product", F.col("_zx") * F.col("_zy"))
    rho = F.greatest(F.lit(-0.999), F.least(F.lit(0.999), F.avg(only("_product")).over(whole)))
    rows = rows.withColumn("_information", pointwise_gaussian_mi(F.col("_zx"), F.col("_zy"), rho))
    names = ("_product", "_information")
    rows = rows.withColumns({f"{c}{k}": v for c in names for k, v in (("_m", F.avg(only(c)).over(whole)), ("_s", spread(c)))})
    upto = whole.orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    judged = rows.filter(~F.col("_cal"))
    judged = judged.withColumns({f"{c}_u": F.sum((F.col(f"{c}_m") - F.col(c)) / F.col(f"{c}_s") - slack).over(upto) for c in names})
    # The running sum less its running minimum is the recursion.
    sums = {f"{c[1:]}_cusum": F.col(f"{c}_u") - F.least(F.lit(0.0), F.min(f"{c}_u").over(upto)) for c in names}
    return judged.withColumns(sums).select("track_id", "seq", *sums)
