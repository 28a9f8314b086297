"""The corpus pipeline: documents that are in a known language, of good quality, unlike each other and free of benchmarks, encoded.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last keep the columns of documents, and the last returns doc_id, n_tokens,
ids_sha256 and decoded_sha256 of what is left. SQL can't express the stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from accordant.llm import byte_bpe, decontaminate, language_id, quality, similar_texts
from accordant.llm.common import table, workspace


def _encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return byte_bpe.encode_digests(docs)


STAGES = [
    ("language_id", language_id.keep_known),
    ("quality", quality.keep_good),
    ("simhash_dedup", similar_texts.keep_one_of_each),
    ("decontamination", decontaminate.drop_contaminated),
    ("byte_bpe", _encoded),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's rows are written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = workspace(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.schema(docs.schema).parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
