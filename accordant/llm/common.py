"""What the operators share: tables, the shared folder and files in it.

Files that tasks write and other tasks read lie under ``spark.checkpoint.dir``,
which every executor sees. Tasks open them through ``pyarrow.fs``, so that the
folder may be local, HDFS or an object store.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession

#: Rows that Python works on at once; an Arrow batch is cut into such slices.
SLICE_ROWS = 256


#: Rows of an Arrow batch at most: a batch is in the JVM and in Python at once.
BATCH_ROWS = 1_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the test data, read by Spark alone. Bounds the session's Arrow batches, as texts may be long."""
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def bound_batches(spark: SparkSession) -> None:
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if not 0 < now <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a folder of our own only where that is unset and all tasks run on this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="accordant-shared-")
        spark.conf.set("spark.checkpoint.dir", found) if spark.conf.isModifiable("spark.checkpoint.dir") else None
        _OWN.setdefault(spark.sparkContext.applicationId, found)
        found = _OWN[spark.sparkContext.applicationId]
    return found if "://" in found else "file://" + found


_OWN: dict[str, str] = {}


def workspace(spark: SparkSession, name: str) -> str:
    """A new folder name in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/accordant/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a written table in the shared folder: computed once, and safe when executors are lost."""
    bound_batches(df.sparkSession)
    path = workspace(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def write_file(uri: str, chunks: Iterator[bytes]) -> int:
    """Write a file under a name of its own, then rename it: a repeated or doubled task leaves one whole file."""
    fs, path = filesystem(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    own = f"{path}.{uuid.uuid4().hex}.tmp"
    size = 0
    with fs.open_output_stream(own) as out:
        for chunk in chunks:
            out.write(chunk)
            size += len(chunk)
    fs.move(own, path)
    return size


def read_file(uri: str, offset: int = 0, length: int | None = None) -> bytes:
    fs, path = filesystem(uri)
    with fs.open_input_file(path) as f:
        if offset:
            f.seek(offset)
        return f.read(length) if length is not None else f.read()


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut to at most ``rows`` rows, so that memory follows a slice and not a batch."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or with underscores before it until ``df`` has no such column (case doesn't count)."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name = "_" + name
    return name
