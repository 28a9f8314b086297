"""A live tap of observation envelopes: strict decoding, sequence admission, and a dead-letter branch that never ends the stream.

Each micro-batch is judged as a DataFrame: size, JSON, envelope, provenance and
the observation's own rules in the JVM, then the sequence of its channel
against the high-water marks of the batch before. Accepted rows, dead letters,
counters and marks are written to folders of that batch's number, the marks
last; a batch that is run again overwrites its own folders, and readers only
see batches whose marks are there. So every payload is told once, whatever is
restarted.

A control row ``reset`` forgets all marks from its place on. Marks are at most
``max_streams`` rows; a new channel beyond that is refused.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from accordant.schema import OBSERVATION
from accordant.sources.jsonl import envelopes

#: What the rules of ``envelopes`` are counted as; rules of the observation itself are ``invalid_observation``.
COUNTED_AS = {
    "not_json": "malformed_json", "keys": "invalid_envelope", "kind": "invalid_envelope", "schema_version": "invalid_envelope",
    "session_identity": "invalid_envelope", "producer_identity": "invalid_envelope", "observation_keys": "invalid_observation",
    "contract_hash": "provenance_mismatch", "wrong_session": "provenance_mismatch", "wrong_producer": "provenance_mismatch",
}
MARKS = "track_id bigint, modality string, epoch bigint, seq bigint"
RESET = "reset"


@dataclass(frozen=True)
class TapConfig:
    """Whom a tap listens to, and its bounds."""

    kind: str
    schema_version: str
    contract_hash: str | None = None
    session_id: str | None = None
    producer_id: str | None = None
    max_payload_bytes: int = 64 * 1024
    max_streams: int = 8_192
    max_forward_gap: int = 1_024

    def __post_init__(self) -> None:
        if min(self.max_payload_bytes, self.max_streams, self.max_forward_gap) < 1:
            raise ValueError("bounds are at least 1")


def decoded(rows: DataFrame, cfg: TapConfig) -> DataFrame:
    """Rows (ordinal, payload, control): the observation's fields and ``reason``, null where all but the sequence is sound."""
    small = F.octet_length("payload") <= cfg.max_payload_bytes
    lines = rows.withColumn("line", F.when(small, F.col("payload")))
    told = envelopes(lines, cfg.kind, cfg.schema_version, cfg.contract_hash, cfg.session_id, cfg.producer_id)
    names = F.create_map(*(F.lit(x) for kv in COUNTED_AS.items() for x in kv))
    why = F.when(F.col("reject_reason").isNotNull(), F.coalesce(names[F.col("reject_reason")], F.lit("invalid_observation")))
    reason = F.when(F.col("control").isNotNull(), F.when(F.col("control") != RESET, "unknown_control"))
    sized = F.when(F.octet_length("payload") > cfg.max_payload_bytes, "payload_too_large").otherwise(why)
    return told.withColumn("reason", F.when(F.col("control").isNull(), sized).otherwise(reason)).drop("reject_reason", "line")


def _sequences(table: pa.Table, gap: int) -> pa.Table:
    """Rows (ordinal, epoch, seq, mark, mark_epoch) of one channel: why each is refused, in the order of arrival."""
    rows = table.sort_by("ordinal")
    names = ("epoch", "seq", "mark", "mark_epoch")
    last: int | None = None
    at: int | None = None
    out = []
    for epoch, seq, mark, mark_epoch in zip(*(rows.column(n).to_pylist() for n in names), strict=True):
        if epoch != at:
            at, last = epoch, mark if mark_epoch == epoch else None
        if last is not None and seq <= last:
            out.append("duplicate_or_regressed_sequence")
        elif last is not None and seq - last > gap:
            out.append("excessive_forward_sequence_gap")
        else:
            out.append(None)
            last = seq
    return pa.table({"ordinal": rows.column("ordinal"), "refused": pa.array(out, pa.string())})


def judged(rows: DataFrame, marks: DataFrame, base: int, cfg: TapConfig) -> DataFrame:
    """``decoded`` rows with ``epoch`` and the final ``reason``, given the marks so far (MARKS) and their epoch."""
    resets = rows.filter((F.col("control") == RESET) & F.col("reason").isNull()).select(F.col("ordinal").alias("at"))
    told = rows.withColumn("epoch", F.lit(base).cast("long"))
    if not resets.isEmpty():
        # Resets are rare; each row counts those up to it.
        before = rows.select("ordinal").join(resets, F.col("at") <= F.col("ordinal")).groupBy("ordinal").agg(F.count("*").alias("n"))
        told = told.join(before, "ordinal", "left").withColumn("epoch", F.col("epoch") + F.coalesce("n", F.lit(0))).drop("n")
    sound = told.filter(F.col("reason").isNull() & F.col("control").isNull())
    known = marks.filter("seq IS NOT NULL").select("track_id", "modality", F.col("epoch").alias("mark_epoch"), F.col("seq").alias("mark"))
    joined = sound.join(known, ["track_id", "modality"], "left")
    # New channels of an epoch, by arrival, as far as there is room.
    new = joined.filter("mark_epoch IS NULL OR mark_epoch <> epoch").groupBy("epoch", "track_id", "modality").agg(F.min("ordinal").alias("first"))
    used = known.groupBy(F.col("mark_epoch").alias("of")).agg(F.count("*").alias("used"))
    ranked = new.withColumn("nth", F.row_number().over(Window.partitionBy("epoch").orderBy("first"))).filter(F.col("nth") <= cfg.max_streams)
    room = ranked.join(F.broadcast(used), F.col("epoch") == F.col("of"), "left").filter(F.col("nth") + F.coalesce("used", F.lit(0)) <= cfg.max_streams)
    fits = room.select("epoch", "track_id", "modality", F.lit(True).alias("fits"))
    open_ = joined.join(fits, ["epoch", "track_id", "modality"], "left").withColumn("has_room", F.coalesce("fits", F.col("mark_epoch") == F.col("epoch"), F.lit(False)))
    few = open_.filter("has_room").select("track_id", "modality", "ordinal", "epoch", "seq", "mark", "mark_epoch")
    gap = cfg.max_forward_gap
    why = few.groupBy("track_id", "modality").applyInArrow(lambda t: _sequences(t, gap), "ordinal bigint, refused string")
    full = open_.filter("NOT has_room").select("ordinal", F.lit("sequence_capacity_exceeded").alias("refused"))
    both = told.join(why.unionByName(full), "ordinal", "left")
    return both.withColumn("reason", F.coalesce("reason", "refused")).drop("refused")


def _new_marks(told: DataFrame, marks: DataFrame, base: int) -> DataFrame:
    """The marks after a batch, of its last epoch; a row without a channel tells the epoch."""
    now = told.agg(F.coalesce(F.max("epoch"), F.lit(base))).first()[0]
    sent = told.filter("reason IS NULL AND control IS NULL").select("track_id", "modality", "epoch", "seq")
    every = marks.filter("seq IS NOT NULL").unionByName(sent).filter(F.col("epoch") == now)
    kept = every.groupBy("track_id", "modality", "epoch").agg(F.max("seq").alias("seq"))
    return kept.unionByName(marks.sparkSession.createDataFrame([(None, None, now, None)], MARKS))


class Tap:
    """The folders of a tap: accepted, dead, counters and marks, each by batch."""

    def __init__(self, folder: str, cfg: TapConfig):
        self.folder, self.cfg = folder.rstrip("/"), cfg

    def _path(self, kind: str, batch: int) -> str:
        return f"{self.folder}/{kind}/batch={batch}"

    def _marks(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(f"{MARKS}, batch bigint").option("basePath", f"{self.folder}/marks").parquet(f"{self.folder}/marks")

    def begin(self, spark: SparkSession) -> None:
        """Marks before the first batch: none."""
        spark.createDataFrame([(None, None, 0, None)], MARKS).write.mode("ignore").parquet(self._path("marks", -1))

    def _kept(self, rows: DataFrame, kind: str, batch: int) -> DataFrame:
        path = self._path(kind, batch)
        rows.write.mode("overwrite").parquet(path)
        return rows.sparkSession.read.schema(rows.schema).parquet(path)

    def take(self, rows: DataFrame, batch: int) -> None:
        """Judge and write one micro-batch (ordinal, payload, control); again is the same."""
        spark = rows.sparkSession
        seen = self._marks(spark).filter(F.col("batch") < batch)
        newest, base = seen.agg(F.max("batch"), F.max_by("epoch", "batch")).first()
        marks = seen.filter(F.col("batch") == newest).drop("batch")
        # Decoded and judged once, written, and read for what follows: no branch can see other rows than another.
        read = self._kept(decoded(rows, self.cfg), "decoded", batch)
        told = self._kept(judged(read, marks, base, self.cfg), "judged", batch)
        sent = F.col("reason").isNull() & F.col("control").isNull()
        told.filter(sent).select("ordinal", "epoch", "session_id", "producer_id", *OBSERVATION.names).write.mode("overwrite").parquet(self._path("accepted", batch))
        told.filter("reason IS NOT NULL").select("ordinal", "payload", "control", "reason").write.mode("overwrite").parquet(self._path("dead", batch))
        state = F.coalesce("reason", F.when(sent, "accepted").otherwise("reset")).alias("state")
        told.groupBy(state).agg(F.count("*").alias("n")).coalesce(1).write.mode("overwrite").parquet(self._path("counters", batch))
        _new_marks(told, marks, base).coalesce(1).write.mode("overwrite").parquet(self._path("marks", batch))

    def start(self, stream: DataFrame, checkpoint: str, **trigger: object) -> StreamingQuery:
        """Run the tap over a stream of (ordinal, payload, control)."""
        self.begin(stream.sparkSession)
        writer = stream.select("ordinal", "payload", "control").writeStream.foreachBatch(self.take).option("checkpointLocation", checkpoint)
        return (writer.trigger(**trigger) if trigger else writer).start()

    def read(self, spark: SparkSession, kind: str) -> DataFrame:
        """Rows of accepted, dead or counters, of finished batches, with their ``batch``."""
        done = self._marks(spark).agg(F.max("batch")).first()[0]
        rows = spark.read.option("basePath", f"{self.folder}/{kind}").parquet(f"{self.folder}/{kind}")
        return rows.filter(F.col("batch") <= done)

    def health(self, spark: SparkSession) -> DataFrame:
        """How many payloads were accepted, and refused for each reason, so far."""
        return self.read(spark, "counters").groupBy("state").agg(F.sum("n").alias("n"))
