"""Sharding by bytes: global prefix sums from per-partition totals, cut at equal targets.

Rows are ordered by id over range partitions. Each partition's total is summed,
the totals (one row a partition) get a running sum, and a running sum inside
each partition added to its partition's base is the global prefix sum. Shard
``s`` takes the rows whose middle byte lies in the ``s``-th of equal parts of
all bytes, so shards are contiguous and no shard misses its target by more
than one row at either end. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from accordant.llm.common import fresh, table, written

SHARDS = 40
#: Bytes that each document takes besides its text.
ROW_OVERHEAD = 16


def byte_shards(rows: DataFrame, order_by: str, size: str, shards: int = SHARDS) -> DataFrame:
    """Add ``shard`` (0 to ``shards - 1``) and ``slot`` (gapless from 0 in each shard).

    ``rows`` should hold ids and sizes only: it is written once to the shared
    folder. Ties and nulls in ``order_by`` (nulls first) are put in order by
    the other columns and then by place, so a hot id spreads over partitions.
    A row of size 0 goes with its neighbours; an empty table gives no rows.
    Columns named shard or slot are refused, any others are kept.
    """
    own = rows.columns
    if {c.lower() for c in own} & {"shard", "slot"}:
        raise ValueError("rows already have a column shard or slot")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place, part, run, number, at = (fresh(rows, c) for c in ("_at", "_part", "_run", "_n", "_row"))
    others = [c for c in own if c != order_by]
    dealt = rows.withColumn(place, F.monotonically_increasing_id())
    keys = [F.col(order_by).asc_nulls_first(), *(F.col(c).asc_nulls_first() for c in others), F.col(place)]
    placed = written(dealt.repartitionByRange(parts, *keys).withColumn(part, F.spark_partition_id()), "byte-shards")
    totals = placed.groupBy(part).agg(F.sum(size).alias("bytes"), F.count("*").alias("rows"))
    # One row a partition: a window without keys over these few rows is no bottleneck.
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    base = F.struct(
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes"),
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows"),
        F.sum("bytes").over(Window.partitionBy()).alias("all"),
    )
    base_at = fresh(rows, "_base")
    bases = totals.select(part, base.alias(base_at))
    ordered = Window.partitionBy(part).orderBy(*keys)
    sums = {
        run: F.sum(size).over(ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
        number: F.row_number().over(ordered),
    }
    # bases has at most `parts` rows, each of four numbers: safe to broadcast at any input size.
    global_rows = placed.withColumns(sums).join(F.broadcast(bases), part)
    base_of = lambda c: F.col(f"`{base_at}`.`{c}`")
    # In whole numbers, so that a cut is the same whatever the sums' size.
    twice = f"(2 * (`{base_at}`.bytes + `{run}`) - `{size}`) * {shards} DIV (2 * `{base_at}`.all)"
    shard = F.expr(f"CAST(IF(`{base_at}`.all > 0, least({shards - 1}, {twice}), 0) AS INT)")
    cut = written(global_rows.withColumns({"shard": shard, at: base_of("rows") + F.col(number) - 1}), "byte-shards-cut")
    first = fresh(rows, "_first")
    firsts = cut.groupBy("shard").agg(F.min(at).alias(first))
    return cut.join(F.broadcast(firsts), "shard").select(*own, "shard", (F.col(at) - F.col(first)).alias("slot"))


def op9_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of near equal bytes. A null text counts no bytes; its crc32 is that of no bytes."""
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + ROW_OVERHEAD).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    out = byte_shards(rows, "doc_id", "size")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


ORACLE = f"""
WITH tab AS MATERIALIZED (SELECT list(c ORDER BY i) AS tab FROM (SELECT i, list_reduce(list_value(i, 0, 0, 0, 0, 0, 0, 0, 0),
  lambda a, b: CASE WHEN a & 1 = 1 THEN xor(3988292384, a >> 1) ELSE a >> 1 END) AS c FROM range(256) t(i))),
h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
b AS (SELECT doc_id, length(x) // 2 + {ROW_OVERHEAD} AS size, list_prepend(4294967295,
  list_transform(string_split(regexp_replace(x, '(..)', '\\1 ', 'g'), ' ')[:-2], lambda v: ('0x' || v)::BIGINT)) AS bytes FROM h),
r AS (SELECT doc_id, size, xor(4294967295, list_reduce(bytes, lambda a, x: xor(a >> 8, tab[xor(a & 255, x) + 1]))) AS text_crc32 FROM b, tab),
s AS (SELECT *, sum(size) OVER () AS total, sum(size) OVER (ORDER BY doc_id NULLS FIRST, size, text_crc32 ROWS UNBOUNDED PRECEDING) AS run FROM r),
c AS (SELECT *, least({SHARDS - 1}, (2 * run - size) * {SHARDS} // (2 * total))::INT AS shard FROM s)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'bytes' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1 AS slot, NULL::INT AS grown_shard FROM c
"""
