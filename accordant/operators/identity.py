"""Canonical identities: digests of configurations and observations, and bindings of a track's evidence to both.

A record's bytes are its domain and its fields, each with its name, a type and
the lengths of both, so no two records share bytes. Whole numbers and doubles
are big-endian; there is one zero. A track is bound by a tree: digests of
``FAN_OUT`` records in order, digests of as many of those, and so on, so that
order counts and a long track isn't one fold.
"""

from __future__ import annotations

import hashlib
import struct
from dataclasses import fields

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from accordant.schema import CODES

DOMAIN = "accordant-identity-v1"
#: Digests that one digest of the tree is of.
FAN_OUT = 1_024
LEVELS = 3
U8, U64, F64, TEXT, DIGEST = 1, 2, 3, 4, 5
PROJECTION = ("p0", "p1", "p2")
PROVENANCE = ("frame_id", "context_id", "prior_id")


def _prefix(name: str, kind: int, length: int) -> bytes:
    return len(name).to_bytes(8, "big") + name.encode() + bytes([kind]) + length.to_bytes(8, "big")


def _domain(name: str) -> bytes:
    return _prefix(DOMAIN, TEXT, len(name)) + name.encode()


def _value(name: str, x: object) -> bytes:
    if isinstance(x, bool):
        return _prefix(name, U8, 1) + bytes([x])
    if isinstance(x, int):
        return _prefix(name, U64, 8) + x.to_bytes(8, "big")
    if isinstance(x, float):
        return _prefix(name, F64, 8) + struct.pack(">d", x + 0.0)
    text = x.encode() if isinstance(x, str) else b"\0".join(y.encode() for y in x)
    return _prefix(name, TEXT, len(text)) + text


def config_digest(config: object) -> str:
    """A parameter class's digest: its name and all its fields in their order."""
    told = b"".join(_value(f.name, getattr(config, f.name)) for f in fields(config))
    return hashlib.sha256(_domain(type(config).__name__) + told).hexdigest()


def suite_digest(configs: tuple[object, ...], modalities: tuple[str, ...]) -> str:
    """One digest of all parameters of an assessment."""
    told = b"".join(_prefix("config", DIGEST, 32) + bytes.fromhex(config_digest(c)) for c in configs)
    return hashlib.sha256(_domain("suite") + told + _value("modalities", modalities)).hexdigest()


def _field(name: str, kind: int, length: int, text: Column) -> Column:
    return F.concat(F.lit(_prefix(name, kind, length).hex()), text)


def _u8(name: str, x: Column) -> Column:
    return _field(name, U8, 1, F.lpad(F.hex(x.cast("long")), 2, "0"))


def _u64(name: str, x: Column) -> Column:
    return _field(name, U64, 8, F.lpad(F.hex(x.cast("long")), 16, "0"))


def _f64(name: str, column: str) -> Column:
    # The engine's call of a static method takes no null.
    bits = F.expr(f"CAST(reflect('java.lang.Double', 'doubleToLongBits', coalesce(`{column}`, 0D) + 0D) AS BIGINT)")
    return F.when(F.col(column).isNotNull(), _field(name, F64, 8, F.lpad(F.hex(bits), 16, "0")))


def _sha(text: Column) -> Column:
    return F.sha2(F.unhex(text), 256)


def observation_digest() -> Column:
    """The digest of an observation's row: scalar fields and, if there is one, its projection."""
    code = F.create_map(*(F.lit(x) for kv in CODES.items() for x in kv))[F.col("modality")]
    scalar = [
        F.lit(_domain("observation").hex()), _u64("track_id", F.col("track_id")), _u64("timestamp_ms", F.col("timestamp_ms")),
        _u64("seq", F.col("seq")), _u8("modality", code + 1), _f64("nis", "nis"), _u8("dof", F.col("dof")),
    ]
    there = F.concat(_u8("projection", F.lit(1)), *(_f64(c, c) for c in PROJECTION), *(_u64(c, F.col(c)) for c in PROVENANCE))
    projection = F.when(F.col("p0").isNotNull(), there).otherwise(_u8("projection", F.lit(0)))
    return _sha(F.concat(*scalar, projection))


def bindings(rows: DataFrame, suite: str, order: tuple[str, ...] = ("seq", "code", "timestamp_ms", "dof", "nis")) -> DataFrame:
    """(track_id, observations, binding): what each track's verdicts are of, and by which parameters.

    Rows must be complete; a null in a row makes its digest, and so its track's
    binding, null. Repeated rows count each. An empty table binds nothing.
    """
    by = Window.partitionBy("track_id").orderBy(*order)
    level = rows.select("track_id", F.row_number().over(by).alias("_nth"), observation_digest().alias("_digest"))
    for step in range(LEVELS):
        group = F.floor((F.col("_nth") - 1) / FAN_OUT) if step < LEVELS - 1 else F.lit(0)
        told = level.groupBy("track_id", group.cast("long").alias("_group")).agg(
            F.sort_array(F.collect_list(F.struct("_nth", "_digest"))).alias("_all"), F.sum("_count" if step else F.lit(1)).alias("_count")
        )
        # A null digest mustn't drop out of the list.
        whole = F.when(~F.exists("_all", lambda x: x["_digest"].isNull()), F.array_join(F.transform("_all", lambda x: x["_digest"]), ""))
        head = F.concat(F.lit(_domain(f"level-{step}").hex()), _u64("count", F.size("_all")))
        level = told.select("track_id", (F.col("_group") + 1).alias("_nth"), _sha(F.concat(head, whole)).alias("_digest"), "_count")
    suite_hex = (_domain("binding") + _prefix("suite", DIGEST, 32)).hex() + suite
    binding = _sha(F.concat(F.lit(suite_hex), _u64("observations", F.col("_count")), F.lit(_prefix("tree", DIGEST, 32).hex()), F.col("_digest")))
    return level.select("track_id", F.col("_count").alias("observations"), binding.alias("binding"))


def bound(assessed: DataFrame, told: DataFrame) -> DataFrame:
    """Add ``binding`` to rows of a track; null where the track has none."""
    return assessed.join(told.select("track_id", "binding"), "track_id", "left")


def combined(parts: list[DataFrame], keys: tuple[str, ...], evidence: tuple[str, ...]) -> DataFrame:
    """Rows that all parts have, with ``evidence`` of the n-th part as ``<name>_<n>``, and ``provenance``.

    Evidence of other observations or parameters can't be combined: where
    bindings differ or one is missing, ``provenance`` is ``mismatched`` and no
    part's evidence is given; else it is ``one``.
    """
    out = None
    for n, part in enumerate(parts):
        own = part.select(*keys, *(F.col(c).alias(f"{c}_{n}") for c in (*evidence, "binding")))
        out = own if out is None else out.join(own, list(keys))
    same = F.lit(True)
    for n in range(len(parts)):
        same = same & F.coalesce(F.col(f"binding_{n}") == F.col("binding_0"), F.lit(False))
    told = {f"{c}_{n}": F.when(same, F.col(f"{c}_{n}")) for c in evidence for n in range(len(parts))}
    bindings_of = [f"binding_{n}" for n in range(len(parts))]
    return out.withColumn("provenance", F.when(same, "one").otherwise("mismatched")).withColumns(told).drop(*bindings_of)
