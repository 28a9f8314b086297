"""Command line: ``python -m accordant.cli replay FILE`` and ``demo``; text reports of small frames."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from accordant.config import CorrelationConfig, DetectorConfig
from accordant.operators import fusion, traces
from accordant.schema import CODES, MODALITIES
from accordant.sources.jsonl import read_jsonl

BARS = "▁▂▃▄▅▆▇█"


def flat(rows: DataFrame) -> DataFrame:
    """Observations as read to the columns that the detectors take."""
    p = F.col("consistency_projection")
    code = F.create_map(*(F.lit(x) for kv in CODES.items() for x in kv))[F.col("modality")]
    return rows.select("track_id", "seq", "timestamp_ms", "modality", code.alias("code"), "nis", "dof", *(F.get(p["values"], i).alias(f"p{i}") for i in range(3)), *(p[c].alias(c) for c in ("frame_id", "context_id", "prior_id")))


def replay(rows: DataFrame, detector: DetectorConfig | None = None, corr: CorrelationConfig | None = None) -> DataFrame:
    """One row a track: histories of every frame's verdicts. Channels are those of all observations."""
    mods = tuple(r.modality for r in rows.select("modality").distinct().limit(len(MODALITIES)).collect())
    return traces.replay_histories(fusion.assessed_frames(flat(rows), mods, detector, corr))


def sparkline(values: list[float], columns: int = 48) -> str:
    """At most ``columns`` values, picked evenly, as bars from least to most."""
    if not values:
        return ""
    picked = [values[c * len(values) // columns] for c in range(columns)] if len(values) > columns else values
    low, high = min(picked), max(picked)
    return "".join(BARS[0 if high == low else int((v - low) / (high - low) * (len(BARS) - 1))] for v in picked)


def describe(row: dict) -> str:
    """A track's history in words."""
    parts = [f"alarm {row['alarm_frames']} frame(s), first seq {row['alarm_first']}, last seq {row['alarm_last']}" if row["alarm_frames"] else "no positive alarm frames"]
    names = (("insufficient", "insufficient-evidence"), ("reset", "explicit-generation-reset"), ("missing_projection", "missing-projection"), ("extraction_error", "projection-extraction-error"), ("analysis_error", "correlation-analysis-error"))
    parts += [f"{label} {row[f'{k}_frames']} frame(s), first seq {row[f'{k}_first']}, last seq {row[f'{k}_last']}" for k, label in names if row[f"{k}_frames"]]
    return "; ".join(parts)


def report(histories: DataFrame, most: int = 16) -> str:
    """The first tracks in words, and the rest as one line."""
    told = histories.orderBy("track_id").limit(most).collect()
    lines = [f"track {r.track_id}: baseline {r.terminal_baseline}, default {r.terminal_verdict}  {describe(r.asDict())}" for r in told]
    rest = traces.with_suppressed_rest(histories, most).filter(F.col("track_id").isNull()).collect()
    lines += [f"{r.tracks} more track(s): {r.alarm_tracks} with alarms, {r.insufficient_tracks} with insufficient evidence" for r in rest]
    return "\n".join(lines)


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="accordant")
    sub = parser.add_subparsers(dest="command", required=True)
    one = sub.add_parser("replay", help="assess a file of observations, one JSON object a line")
    one.add_argument("path")
    one.add_argument("--tracks", type=int, default=16)
    two = sub.add_parser("demo", help="assess the scenario over test tables")
    two.add_argument("tables")
    given = parser.parse_args(arguments)
    spark = SparkSession.builder.appName("accordant").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if given.command == "replay":
        print(report(replay(read_jsonl(spark, given.path)), given.tracks))
    else:
        from accordant import views

        assessed = fusion.assessed_frames(views.scenario(spark, given.tables), views.CHANNELS)
        print(report(traces.replay_histories(assessed)))
        for r in views.scenario(spark, given.tables).filter("track_id = 0").groupBy("modality").agg(F.sort_array(F.collect_list(F.struct("seq", "nis"))).alias("x")).orderBy("modality").collect():
            print(f"{r.modality:>10} {sparkline([x.nis for x in r.x])}")


if __name__ == "__main__":
    main()
