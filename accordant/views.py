"""Deterministic observation views over the test tables, for queries; no random numbers, the same rows in any engine.

``scenario``: three channels whose projections share a latent with correlation
``RHO``, from unit vectors scaled to about standard normal coordinates; in the
last two thirds of a track the acoustic channel follows a phantom instead.
``captured``: the same with what a capture has: a missing channel, absent
projections, clock skew, an outage, another context, repeated rows, changed
degrees of freedom, a clock's step, a huge value, one that is no number, a
negative one, rows without a sequence and a prior that is used again.
``user_events``: scalar observations with genuine gaps, one channel per event type.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from accordant.schema import CODES

CHANNELS = ("visual", "acoustic", "radar")
SPOOFED = "acoustic"
RHO, DECOUPLING, AXES = 0.7, 0.9, 3
#: Frames of a track: there are as many tracks as the vectors give.
TRACK_FRAMES = 250
#: Places in the vector of the shared latent and of the phantom.
LATENT_AT, PHANTOM_AT, SCALE = 18, 21, 8.0
DT_MS, CAPTURE_DT_MS, CYCLE = 100, 2_000, 90
#: A finite value that would stay in running totals.
HUGE = 1e17
#: The frame of every other track that has the prior of the frame before.
REUSED_AT = 210
EVENT_MODALITY = {"view": "visual", "click": "thermal", "purchase": "acoustic", "signup": "radar", "error": "lidar"}


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    track = F.floor(F.col("vec_id") / TRACK_FRAMES).cast("long")
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(
        track.alias("track_id"), (F.row_number().over(Window.partitionBy(track).orderBy("vec_id")) - 1).cast("long").alias("seq"), F.count("*").over(Window.partitionBy(track)).alias("_len"), F.col("embedding").alias("_v")
    )


def _coordinate(code: int, axis: int, spoofed: bool) -> Column:
    at = lambda i: F.col("_v")[i].cast("double")
    latent = at(LATENT_AT + axis)
    if spoofed:
        phantom = math.sqrt(1 - DECOUPLING) * latent + math.sqrt(DECOUPLING) * at(PHANTOM_AT + axis)
        latent = F.when(F.col("seq") >= F.floor(F.col("_len") / 3), phantom).otherwise(latent)
    return SCALE * (math.sqrt(RHO) * latent + math.sqrt(1 - RHO) * at(3 * code + axis))


def _observations(vectors: DataFrame, dt_ms: int, spoofed: bool = True) -> DataFrame:
    channels = F.array(*(F.struct(F.lit(m).alias("modality"), F.lit(CODES[m]).alias("code"), *(_coordinate(CODES[m], a, spoofed and m == SPOOFED).alias(f"p{a}") for a in range(AXES))) for m in CHANNELS))
    rows = vectors.select("track_id", "seq", F.explode(channels).alias("c")).select("track_id", "seq", (F.col("seq") * dt_ms + F.col("c.code")).alias("timestamp_ms"), "c.modality", "c.code", *(f"c.p{a}" for a in range(AXES)))
    return rows.select("track_id", "seq", "timestamp_ms", "modality", "code", (F.col("p0") * F.col("p0") + F.col("p1") * F.col("p1") + F.col("p2") * F.col("p2")).alias("nis"), F.lit(3).alias("dof"), "p0", "p1", "p2", F.lit(1).cast("long").alias("frame_id"), F.lit(1).cast("long").alias("context_id"), (F.col("seq") + 1).alias("prior_id"))


def scenario(spark: SparkSession, sf_dir: str, spoofed: bool = True) -> DataFrame:
    return _observations(_vectors(spark, sf_dir), DT_MS, spoofed)


def captured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A capture, with rows that must be refused: repeated ones, other degrees of freedom, and those after a clock's step."""
    at = F.col("seq") % CYCLE
    radar, visual, acoustic = (F.col("modality") == m for m in ("radar", "visual", "acoustic"))
    rows = _observations(_vectors(spark, sf_dir), CAPTURE_DT_MS).filter(~((F.col("modality") == "acoustic") & (at == 40)) & ~at.between(80, 85))
    absent = at == 70
    told = (
        rows.withColumn("timestamp_ms", F.col("timestamp_ms") + F.when(radar & (at == 20), 1_500).when(visual & (at == 62), 5_000).otherwise(0))
        .withColumn("nis", F.when(radar & (at == 45), F.lit(HUGE)).when(acoustic & (at == 41), F.lit(math.nan)).when(radar & (at == 86), F.lit(-1.0)).otherwise(F.col("nis")))
        .withColumn("prior_id", F.when((F.col("track_id") % 2 == 0) & (F.col("seq") == REUSED_AT), F.col("prior_id") - 1).otherwise(F.col("prior_id")))
        .withColumn("dof", F.when(visual & (at == 55), 2).otherwise(F.col("dof")))
        .withColumns({c: F.when(~absent, F.col(c)) for c in ("p0", "p1", "p2", "frame_id", "context_id", "prior_id")})
        .withColumn("context_id", F.col("context_id") + F.floor(F.col("seq") / 130))
    )
    again = told.filter(radar & (at == 30)).withColumns({"nis": F.lit(900.0), "timestamp_ms": F.col("timestamp_ms") + 7})
    lost = told.filter(radar & (at == 31)).withColumn("seq", F.lit(None).cast("long"))
    return told.unionByName(again).unionByName(lost)


def user_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq counts the channel's events; day is the event's day since the epoch."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    modality = F.create_map(*(F.lit(x) for kv in EVENT_MODALITY.items() for x in kv))[F.col("event_type")]
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    rows = events.select("event_id", F.col("user_id").alias("track_id"), modality.alias("modality"), ms.alias("timestamp_ms"), (F.col("value") * 3 / 50).alias("nis"), F.lit(3).alias("dof"))
    own = Window.partitionBy("track_id", "modality").orderBy("timestamp_ms", "event_id")
    return rows.filter(F.col("modality").isNotNull()).select("track_id", (F.row_number().over(own) - 1).cast("long").alias("seq"), "timestamp_ms", "modality", F.create_map(*(F.lit(x) for kv in CODES.items() for x in kv))[F.col("modality")].alias("code"), "nis", "dof", F.floor(F.col("timestamp_ms") / 86_400_000).alias("day"), "event_id")


def _coordinate_sql(axis: int) -> str:
    at = lambda i: f"CAST(v[{i + 1} + {axis}] AS DOUBLE)"
    latent = f"CASE WHEN m.modality = '{SPOOFED}' AND seq >= floor(len / 3) THEN {math.sqrt(1 - DECOUPLING)!r} * {at(LATENT_AT)} + {math.sqrt(DECOUPLING)!r} * {at(PHANTOM_AT)} ELSE {at(LATENT_AT)} END"
    return f"{SCALE} * ({math.sqrt(RHO)!r} * ({latent}) + {math.sqrt(1 - RHO)!r} * CAST(v[3 * m.code + {axis + 1}] AS DOUBLE)) AS p{axis}"


def scenario_sql(dt_ms: int = DT_MS) -> str:
    """CTEs that end in ``obs``."""
    values = ", ".join(f"('{m}', {CODES[m]})" for m in CHANNELS)
    return f"""vec AS (SELECT vec_id // {TRACK_FRAMES} AS track_id, row_number() OVER (PARTITION BY vec_id // {TRACK_FRAMES} ORDER BY vec_id) - 1 AS seq,
  count(*) OVER (PARTITION BY vec_id // {TRACK_FRAMES}) AS len, embedding AS v FROM embeddings),
raw AS (SELECT track_id, seq, seq * {dt_ms} + m.code AS timestamp_ms, m.modality, m.code, {", ".join(map(_coordinate_sql, range(AXES)))} FROM vec, (VALUES {values}) m(modality, code)),
obs AS (SELECT track_id, seq, timestamp_ms, modality, code, p0 * p0 + p1 * p1 + p2 * p2 AS nis, 3 AS dof, p0, p1, p2, 1 AS frame_id, 1 AS context_id, seq + 1 AS prior_id FROM raw)"""


def captured_sql() -> str:
    """CTEs that end in ``obs``."""
    base = scenario_sql(CAPTURE_DT_MS).replace("obs AS (", "whole AS (")
    kept = ", ".join(f"CASE WHEN seq % {CYCLE} <> 70 THEN {c} END AS {c}" for c in ("p0", "p1", "p2", "frame_id"))
    return f"""{base},
told AS (SELECT track_id, seq, modality, code, {kept},
  timestamp_ms + CASE WHEN modality = 'radar' AND seq % {CYCLE} = 20 THEN 1500 WHEN modality = 'visual' AND seq % {CYCLE} = 62 THEN 5000 ELSE 0 END AS timestamp_ms,
  CASE WHEN modality = 'radar' AND seq % {CYCLE} = 45 THEN {HUGE!r} WHEN modality = 'acoustic' AND seq % {CYCLE} = 41 THEN 'NaN'::DOUBLE
  WHEN modality = 'radar' AND seq % {CYCLE} = 86 THEN -1.0 ELSE nis END AS nis, CASE WHEN modality = 'visual' AND seq % {CYCLE} = 55 THEN 2 ELSE dof END AS dof,
  CASE WHEN seq % {CYCLE} <> 70 THEN context_id + floor(seq / 130)::BIGINT END AS context_id, CASE WHEN seq % {CYCLE} <> 70 THEN prior_id - (track_id % 2 = 0 AND seq = {REUSED_AT})::INT END AS prior_id
  FROM whole WHERE NOT (modality = 'acoustic' AND seq % {CYCLE} = 40) AND NOT (seq % {CYCLE} BETWEEN 80 AND 85)),
obs AS (SELECT * FROM told UNION ALL SELECT * REPLACE (timestamp_ms + 7 AS timestamp_ms, 900.0::DOUBLE AS nis) FROM told WHERE modality = 'radar' AND seq % {CYCLE} = 30
  UNION ALL SELECT * REPLACE (NULL::BIGINT AS seq) FROM told WHERE modality = 'radar' AND seq % {CYCLE} = 31)"""


def user_events_sql() -> str:
    """CTEs that end in ``obs``."""
    case = lambda col, pairs: f"CASE {col} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in pairs) + " END"
    modality = case("event_type", [(k, f"'{m}'") for k, m in EVENT_MODALITY.items()])
    code = case("event_type", [(k, CODES[m]) for k, m in EVENT_MODALITY.items()])
    return f"""obs AS (SELECT user_id AS track_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY epoch_ms(ts), event_id) - 1 AS seq, epoch_ms(ts) AS timestamp_ms,
  {modality} AS modality, {code} AS code, value * 3 / 50 AS nis, 3 AS dof, floor(epoch_ms(ts) / 86400000)::BIGINT AS day, event_id FROM events WHERE {modality} IS NOT NULL)"""
