"""Deployment registry: a small document, checked on the driver, and interval joins to it."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A registry is a configuration document; a larger one isn't broadcast but refused.
MAX_BYTES = 4 << 20


def _no_repeats(pairs: list[tuple[str, object]]) -> dict:
    keys = [k for k, _ in pairs]
    if len(keys) != len(set(keys)):
        raise ValueError(f"repeated key in {sorted(keys)}")
    return dict(pairs)


@dataclass(frozen=True)
class Registry:
    document: dict

    @classmethod
    def from_json(cls, text: str, pinned: str | None = None) -> Registry:
        """Strict JSON without repeated keys; sorted into its canonical order; checked; and of the pinned digest, if one is given."""
        if len(text.encode()) > MAX_BYTES:
            raise ValueError(f"a registry has at most {MAX_BYTES} bytes")
        found = cls(cls._canonical(json.loads(text, object_pairs_hook=_no_repeats, parse_constant=_refuse)))
        found.validate()
        if pinned is not None and found.digest() != pinned:
            raise ValueError("the registry hasn't the pinned digest")
        return found

    @staticmethod
    def _canonical(doc: dict) -> dict:
        frames = [{**f, "source_frames": sorted(f.get("source_frames", []), key=lambda s: s["canonical_source_frame"])} for f in doc["frames"]]
        contexts = [{**c, "expected_modalities": sorted(c["expected_modalities"], key=lambda m: m["modality"])} for c in doc["contexts"]]
        return {**doc, "frames": sorted(frames, key=lambda f: f["frame_id"]), "contexts": sorted(contexts, key=lambda c: c["context_id"])}

    def validate(self) -> None:
        frames = {f["frame_id"]: f for f in self.document["frames"]}
        if len(frames) != len(self.document["frames"]) or len({c["context_id"] for c in self.document["contexts"]}) != len(self.document["contexts"]):
            raise ValueError("identifiers of frames and contexts must be unique")
        for part in [*self.document["frames"], *self.document["contexts"]]:
            lo, hi = part["applicability"]["valid_from_timestamp_ms"], part["applicability"].get("valid_until_timestamp_ms")
            if hi is not None and hi < lo:
                raise ValueError("an interval ends before it begins")
        for c in self.document["contexts"]:
            if c["frame_id"] not in frames:
                raise ValueError(f"context {c['context_id']} is of no frame")
            names = [m["modality"] for m in c["expected_modalities"]]
            if not names or len(names) != len(set(names)):
                raise ValueError("a context expects distinct modalities, at least one")

    def digest(self) -> str:
        return hashlib.sha256(json.dumps(self.document, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()

    def contexts(self, spark: SparkSession) -> DataFrame:
        """context_id, frame_id, its interval and its frame's, and modalities."""
        frames = {f["frame_id"]: f["applicability"] for f in self.document["frames"]}
        rows = [
            (c["context_id"], c["frame_id"], c["applicability"]["valid_from_timestamp_ms"], c["applicability"].get("valid_until_timestamp_ms"), frames[c["frame_id"]]["valid_from_timestamp_ms"], frames[c["frame_id"]].get("valid_until_timestamp_ms"), [m["modality"] for m in c["expected_modalities"]])
            for c in self.document["contexts"]
        ]
        return spark.createDataFrame(rows, "context_id bigint, registered_frame_id bigint, valid_from bigint, valid_until bigint, frame_from bigint, frame_until bigint, modalities array<string>")


def _refuse(name: str) -> None:
    raise ValueError(f"{name} is no JSON number")


def within(ts: Column, low: Column, high: Column) -> Column:
    """Both ends included; no high end is open."""
    return (ts >= low) & (high.isNull() | (ts <= high))


def bind(rows: DataFrame, contexts: DataFrame) -> DataFrame:
    """Add ``binding``: bound, or why a row (frame_id, context_id, modality, timestamp_ms) isn't.

    Contexts come from a document of bounded size, so they are broadcast.
    """
    joined = rows.join(F.broadcast(contexts), "context_id", "left")
    reason = (
        F.when(F.col("registered_frame_id").isNull(), "unknown_context")
        .when(F.col("registered_frame_id") != F.col("frame_id"), "context_frame_mismatch")
        .when(~within(F.col("timestamp_ms"), F.col("frame_from"), F.col("frame_until")), "frame_not_applicable")
        .when(~within(F.col("timestamp_ms"), F.col("valid_from"), F.col("valid_until")), "context_not_applicable")
        .when(~F.array_contains("modalities", F.col("modality")), "unexpected_modality")
        .otherwise("bound")
    )
    return joined.withColumn("binding", reason).select(*rows.columns, "binding")
