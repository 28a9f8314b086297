"""Bounded, strict JSON Lines: a scan that rejects what a strict decoder would, and a sink that checks everything before its first byte.

Spark's JSON reader takes the last of repeated keys and ignores unknown ones;
both are found here by comparing each object's own key list. Limits on records
and bytes are checked by one aggregate over the scan, order by file position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from accordant.config import JsonlLimits
from accordant.operators.admission import first_broken, observation_rules, valid_identifier
from accordant.schema import OBSERVATION

REQUIRED = ("track_id", "timestamp_ms", "seq", "modality", "nis", "dof")


def _keys(text: Column, allowed: list[str], required: tuple[str, ...]) -> Column:
    """Whether an object's keys repeat, are unknown, or miss a required one."""
    keys = F.json_object_keys(text)
    bad = (F.size(keys) != F.size(F.array_distinct(keys))) | (F.size(F.array_except(keys, F.array(*map(F.lit, allowed)))) > 0) | (F.size(F.array_except(F.array(*map(F.lit, required)), keys)) > 0)
    return F.coalesce(bad, F.lit(True))


def scan(spark: SparkSession, path: str, limits: JsonlLimits | None = None) -> DataFrame:
    """Lines as observations: file, position (byte order in the file), line, the fields, and ``reject_reason`` (null if admitted).

    A trailing carriage return is dropped; blank lines are rejected as such.
    """
    limits = limits or JsonlLimits()
    raw = spark.read.text(path).select(F.regexp_replace("value", "\r$", "").alias("line"), F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("position"))
    parsed = raw.withColumn("o", F.from_json("line", T.StructType([*OBSERVATION, T.StructField("_broken", T.StringType())]), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken", "allowNonNumericNumbers": "false"}))
    projection = F.get_json_object("line", "$.consistency_projection")
    syntax = [
        ("line_too_long", F.octet_length("line") > limits.max_line_bytes),
        ("blank_line", F.trim("line") == ""),
        ("not_json", F.col("o").isNull() | F.col("o._broken").isNotNull() | F.json_object_keys("line").isNull()),
        ("keys", _keys(F.col("line"), OBSERVATION.names, REQUIRED)),
        ("projection_keys", F.when(projection.isNotNull(), _keys(projection, OBSERVATION["consistency_projection"].dataType.names, tuple(OBSERVATION["consistency_projection"].dataType.names))).otherwise(False)),
    ]
    reason = first_broken(syntax)
    flat = parsed.withColumn("_syntax", reason).select("file", "position", "line", "_syntax", *(F.col("o")[n].alias(n) for n in OBSERVATION.names))
    return flat.withColumn("reject_reason", F.coalesce("_syntax", first_broken(observation_rules()))).drop("_syntax")


def channel_guard(scanned: DataFrame, limits: JsonlLimits | None = None) -> DataFrame:
    """Reject admitted rows whose sequence doesn't exceed their channel's before them in file order."""
    w = Window.partitionBy("track_id", "modality").orderBy("file", "position")
    good = F.when(F.col("reject_reason").isNull(), F.col("seq"))
    before = F.max(good).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return scanned.withColumn("reject_reason", F.coalesce("reject_reason", F.when(F.col("seq") <= before, "sequence_not_increasing")))


def checked(scanned: DataFrame, limits: JsonlLimits | None = None) -> DataFrame:
    """The admitted observations; raises ValueError on any reject or if the scan is over its limits."""
    limits = limits or JsonlLimits()
    told = channel_guard(scanned, limits)
    row = told.agg(F.count("*").alias("records"), F.coalesce(F.sum(F.octet_length("line") + 1), F.lit(0)).alias("bytes"), F.count("reject_reason").alias("rejects"), F.min("reject_reason").alias("reason")).first()
    if row.rejects:
        raise ValueError(f"{row.rejects} lines rejected, such as for {row.reason}")
    if row.records > limits.max_records or row.bytes > limits.max_total_bytes:
        raise ValueError(f"{row.records} records and {row.bytes} bytes are over the limits")
    streams = told.select("track_id", "modality").distinct().limit(limits.max_streams + 1).count()
    if streams > limits.max_streams:
        raise ValueError(f"more than {limits.max_streams} channels")
    return told.select(*OBSERVATION.names)


def read_jsonl(spark: SparkSession, path: str, limits: JsonlLimits | None = None) -> DataFrame:
    return checked(scan(spark, path, limits), limits)


def write_jsonl(rows: DataFrame, path: str, limits: JsonlLimits | None = None) -> None:
    """Write observations, null fields left out, after all of them have passed admission and limits."""
    limits = limits or JsonlLimits()
    line = F.to_json(F.struct(*OBSERVATION.names), {"ignoreNullFields": "true"})
    ready = rows.select(*OBSERVATION.names, line.alias("line"), first_broken(observation_rules()).alias("reject_reason"))
    told = ready.agg(F.count("reject_reason").alias("rejects"), F.min("reject_reason").alias("reason"), F.count("*").alias("records"), F.max(F.octet_length("line")).alias("longest"), F.sum(F.octet_length("line") + 1).alias("bytes")).first()
    if told.rejects:
        raise ValueError(f"{told.rejects} observations can't be written, such as for {told.reason}")
    if told.records > limits.max_records or (told.longest or 0) > limits.max_line_bytes or (told.bytes or 0) > limits.max_total_bytes:
        raise ValueError("the output is over its limits")
    ready.select("line").write.text(path)


ENVELOPE = T.StructType([T.StructField(n, T.StringType()) for n in ("kind", "schema_version", "ncp_version", "contract_hash", "session_id", "producer_id")] + [T.StructField("observation", OBSERVATION)])


def envelopes(lines: DataFrame, kind: str, schema_version: str, contract_hash: str | None = None, session_id: str | None = None, producer_id: str | None = None) -> DataFrame:
    """Decode a column ``line`` of observation envelopes: the observation's fields, session_id, producer_id and ``reject_reason``.

    Order of checks: syntax, keys, versions, identities, whom they are for, and the observation's own rules.
    """
    e = lines.withColumn("e", F.from_json("line", T.StructType([*ENVELOPE, T.StructField("_broken", T.StringType())]), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken", "allowNonNumericNumbers": "false"}))
    c = lambda n: F.col("e")[n]
    for_us = lambda n, want: F.lit(False) if want is None else c(n) != want
    rules = [
        ("not_json", F.col("e").isNull() | c("_broken").isNotNull() | F.json_object_keys("line").isNull()),
        ("keys", _keys(F.col("line"), ENVELOPE.names, tuple(ENVELOPE.names))),
        ("observation_keys", _keys(F.get_json_object("line", "$.observation"), OBSERVATION.names, REQUIRED)),
        ("kind", c("kind") != kind),
        ("schema_version", c("schema_version") != schema_version),
        ("session_identity", ~valid_identifier(c("session_id"))),
        ("producer_identity", ~valid_identifier(c("producer_id"))),
        ("contract_hash", for_us("contract_hash", contract_hash)),
        ("wrong_session", for_us("session_id", session_id)),
        ("wrong_producer", for_us("producer_id", producer_id)),
    ]
    flat = e.withColumn("_syntax", first_broken(rules)).select(*lines.columns, "_syntax", F.col("e.session_id").alias("session_id"), F.col("e.producer_id").alias("producer_id"), *(F.col("e.observation")[n].alias(n) for n in OBSERVATION.names))
    return flat.withColumn("reject_reason", F.coalesce("_syntax", first_broken(observation_rules()))).drop("_syntax")


def topic(realm: str, session_id: str, leaf: str) -> str:
    """A topic key of valid parts."""
    import re

    from accordant.operators.admission import IDENTIFIER

    for part in (*realm.split("/"), session_id, leaf):
        if not re.fullmatch(IDENTIFIER.strip("^$"), part):
            raise ValueError(f"{part!r} is no topic part")
    return f"{realm}/session/{session_id}/{leaf}"
