"""A committed artifact: tasks hash what they write, a manifest lists files and digests, and one record, moved into place last, makes it valid.

A file's name has its task's attempt, so what a lost or repeated task leaves
behind is in no manifest and is never read. Without the record there is no
artifact, whatever files there are.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

MOST_CONFIG_BYTES = 1 << 20
MANIFEST = "name string, rows bigint, bytes bigint, sha256 string"
#: Digests of files are hashed in groups of this many, and those of groups once more.
GROUP = 4_096
_RECORD, _READ = "artifact.json", 1 << 20


class ArtifactError(ValueError):
    """Why an artifact can't be written or read."""


def decoded_config(text: str) -> dict:
    """A configuration's JSON object, strictly: bounded, no repeated key at any depth, nothing that JSON doesn't have."""

    def once(pairs: list[tuple[str, object]]) -> dict:
        keys = [k for k, _ in pairs]
        if len(set(keys)) < len(keys):
            raise ArtifactError(f"repeated key {next(k for k in keys if keys.count(k) > 1)!r}")
        return dict(pairs)

    def no_number(name: str) -> object:
        raise ArtifactError(f"{name} is no JSON number")

    if len(text.encode()) > MOST_CONFIG_BYTES:
        raise ArtifactError(f"a configuration has at most {MOST_CONFIG_BYTES} bytes")
    try:
        found = json.loads(text, object_pairs_hook=once, parse_constant=no_number)
    except (json.JSONDecodeError, RecursionError) as why:
        raise ArtifactError(f"no JSON: {why}") from None
    if not isinstance(found, dict):
        raise ArtifactError("a configuration is an object")
    return found


def canonical_config(text: str) -> str:
    """The one text of all configurations that say the same."""
    return json.dumps(decoded_config(text), sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def _written(folder: str):  # noqa: ANN202
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = fs.FileSystem.from_uri(folder)
        task = TaskContext.get()
        name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}.jsonl"
        digest, rows, size = hashlib.sha256(), 0, 0
        with store.open_output_stream(f"{path}/data/{name}") as out:
            for batch in batches:
                for line in batch.column(0):
                    told = line.as_py().encode() + b"\n"
                    digest.update(told)
                    out.write(told)
                    rows, size = rows + 1, size + len(told)
        yield pa.RecordBatch.from_pydict({"name": [name], "rows": [rows], "bytes": [size], "sha256": [digest.hexdigest()]})

    return write


def _hashed(folder: str):  # noqa: ANN202
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = fs.FileSystem.from_uri(folder)
        for batch in batches:
            faults = []
            for name, size, sha256 in zip(*(batch.column(c).to_pylist() for c in ("name", "bytes", "sha256")), strict=True):
                at = f"{path}/data/{name}"
                info = store.get_file_info(at)
                if info.type != fs.FileType.File:
                    faults.append("missing")
                    continue
                digest = hashlib.sha256()
                with store.open_input_stream(at) as given:
                    while piece := given.read(_READ):
                        digest.update(piece)
                faults.append("size" if info.size != size else None if digest.hexdigest() == sha256 else "digest")
            yield pa.RecordBatch.from_arrays([batch.column("name"), pa.array(faults, pa.string())], ["name", "fault"])

    return read


def _root(manifest: DataFrame) -> tuple[str, int, int]:
    """Digest of all entries in the order of their names, and the sums of files and rows; the driver sees a digest a group."""
    part = F.regexp_extract("name", r"part-(\d+)-", 1).cast("long")
    entry = F.concat_ws("\x1f", "name", F.col("rows").cast("string"), F.col("bytes").cast("string"), "sha256")
    groups = manifest.groupBy(F.floor(part / GROUP).alias("g")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(entry)), "\n"), 256).alias("d"), F.count("*").alias("n"), F.sum("rows").alias("rows"))
    told = groups.orderBy("g").collect()
    return hashlib.sha256("\n".join(r.d for r in told).encode()).hexdigest(), sum(r.n for r in told), sum(r.rows for r in told)


def commit(rows: DataFrame, folder: str, config: str) -> dict:
    """Write rows as JSON Lines, with the configuration that they come of; the artifact's record.

    Each partition is a file. A folder that has a record is refused, as is one
    that another run began. Columns that are null are left out of a line.
    """
    spark, canonical = rows.sparkSession, canonical_config(config)
    store, path = fs.FileSystem.from_uri(folder)
    if store.get_file_info(path).type != fs.FileType.NotFound:
        raise ArtifactError(f"{folder} is there already; evidence is neither mixed nor overwritten")
    store.create_dir(f"{path}/data")
    lines = rows.select(F.to_json(F.struct(*(F.col(f"`{c}`") for c in rows.columns))).alias("line"))
    # The one action over the rows: what its successful tasks tell is the manifest.
    lines.mapInArrow(_written(folder), MANIFEST).write.parquet(f"{folder}/manifest")
    root, files, n = _root(spark.read.schema(MANIFEST).parquet(f"{folder}/manifest"))
    record = {"schema": rows.schema.json(), "config": canonical, "config_sha256": hashlib.sha256(canonical.encode()).hexdigest(), "manifest_sha256": root, "files": files, "rows": n}
    with store.open_output_stream(f"{path}/{_RECORD}.new") as out:
        out.write(json.dumps(record, sort_keys=True, indent=1).encode())
    store.move(f"{path}/{_RECORD}.new", f"{path}/{_RECORD}")
    return record


def record_of(folder: str) -> dict:
    """The record of a committed artifact."""
    store, path = fs.FileSystem.from_uri(folder)
    if store.get_file_info(f"{path}/{_RECORD}").type != fs.FileType.File:
        raise ArtifactError(f"{folder} has no committed artifact")
    with store.open_input_stream(f"{path}/{_RECORD}") as given:
        return decoded_config(given.read().decode())


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """The files of a committed artifact, if they are those of its record."""
    record, found = record_of(folder), spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    if _root(found)[0] != record["manifest_sha256"]:
        raise ArtifactError("the manifest isn't that of the record")
    if hashlib.sha256(record["config"].encode()).hexdigest() != record["config_sha256"]:
        raise ArtifactError("the configuration isn't that of the record")
    return found


def faults(spark: SparkSession, folder: str) -> DataFrame:
    """name and fault (missing, size, digest) of each listed file that isn't as it was written; files are hashed in pieces, by tasks."""
    listed = manifest(spark, folder)
    return listed.repartition("name").mapInArrow(_hashed(folder), "name string, fault string").filter("fault IS NOT NULL")


def rows_of(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of a committed artifact. Files outside its manifest aren't read, listed ones only if they are whole."""
    bad = faults(spark, folder).limit(1).collect()
    if bad:
        raise ArtifactError(f"{bad[0]['name']}: {bad[0].fault}")
    schema = StructType.fromJson(json.loads(record_of(folder)["schema"]))
    told = spark.read.schema(schema).json(f"{folder}/data")
    names = F.broadcast(manifest(spark, folder).select("name")) if record_of(folder)["files"] <= GROUP else manifest(spark, folder).select("name")
    file = F.regexp_extract("_metadata.file_path", r"([^/]+)$", 1)
    return told.withColumn("_file", file).join(names, F.col("_file") == F.col("name"), "left_semi").select(*(f"`{c}`" for c in schema.names))
