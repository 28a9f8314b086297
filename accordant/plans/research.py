"""Queries of the information layer and of generated studies; SQL can't express them, tests pin them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from accordant import views
from accordant.operators import correlation, coupling, evidence, fusion, information, magnitude
from accordant.plans.detectors import DETECTOR, MODS

def pid_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MI consensus of each track's newest suffix, by axis."""
    rows = magnitude.generations(views.scenario(spark, sf_dir), DETECTOR, MODS)
    wide = magnitude.frames(magnitude.channel_reports(magnitude.channel_windows(rows, DETECTOR), DETECTOR, len(MODS)), MODS, fusion.PROVENANCE)
    return information.pid_reports(correlation.aligned(wide, DETECTOR, MODS), MODS, information.PidConfig())


def coupling_aucs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coupling.score_aucs(coupling.coupling_scores(spark), ("rho", "mi"))


def parity_aucs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coupling.score_aucs(coupling.parity_scores(spark, trials=20), ("rho", "pairwise", "joint"))


def null_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coupling.null_rates(spark)


def study_records(spark: SparkSession, sf_dir: str, study: evidence.StudyConfig | None = None) -> DataFrame:
    """The records of every condition's trials, at the published size unless another study is given."""
    return evidence.records(spark, study or evidence.StudyConfig())


QUERIES = {"pid_reports": pid_reports, "coupling_aucs": coupling_aucs, "parity_aucs": parity_aucs, "null_rates": null_rates, "study_records": study_records}
ORACLES: dict[str, str] = {}
