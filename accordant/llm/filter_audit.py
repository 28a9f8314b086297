r"""Audit of how filters interact: every order of five filters replayed over all documents.

Each document gets one bit a filter that it fails. Documents of equal bits,
part and labels behave alike in every order, so they are counted first (with
map-side combining) and the counts stand for them in the replay: crossed with
the 120 broadcast orders, exploded into five steps, first failure computed,
and conditionally aggregated. What is crossed has at most 128 rows a part,
whatever the table holds.

Filters: A under ``LEAST_WORDS`` words; B fewer than ``LEAST_DISTINCT`` per
cent of them distinct; C more than ``MOST_CAPITALS`` per cent of code points
in A-Z; D any of ``#$%&*|``; E the text of a smaller id, anywhere in the table.
A word is a maximal run without the ASCII blanks; case counts.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from accordant.llm.common import slices, table

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in itertools.permutations(FILTERS)]
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 100, 80, 10
#: Characters of a text above which its words are counted as rows and not as one array.
LONG_CHARS = 1 << 20
#: Words of a long text that become rows together.
TOGETHER = 4_096
BLANKS = r"[\x20\x09-\x0D]+"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def bit(letter: str) -> int:
    return 1 << FILTERS.index(letter)


def _bit(letter: str, fails: Column) -> Column:
    return F.when(fails, bit(letter)).otherwise(0)


def _length_bits(text: Column, words: Column) -> Column:
    """The bits of A, C and D, as a whole number."""
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    many = 100 * capitals.cast("long") > MOST_CAPITALS * F.length(text).cast("long")
    marked = text.rlike("[#$%&*|]")
    return _bit("A", words < LEAST_WORDS).bitwiseOR(_bit("C", many)).bitwiseOR(_bit("D", marked))


def _distinct_bit(words: Column, distinct: Column) -> Column:
    return _bit("B", 100 * distinct.cast("long") < LEAST_DISTINCT * words.cast("long"))


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(digest, _words) of long texts, a bounded number of words in a row."""
    for batch in slices(batches, 1):
        digest, text = batch.column(0)[0].as_py(), batch.column(1)[0].as_py()
        found = (m.group() for m in WORD.finditer(text))
        while some := list(itertools.islice(found, TOGETHER)):
            yield pa.RecordBatch.from_arrays([pa.array([digest], pa.binary()), pa.array([some])], ["digest", "_words"])


def flagged(
    docs: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang", long_chars: int = LONG_CHARS
) -> DataFrame:
    """(key, part, digest, mask) of each row: bits of A to D, and the text's SHA-256.

    A null text or part counts as empty. Words of a text over ``long_chars``
    characters become rows, whose distinct ones are counted by (text, word)
    over all partitions; no task holds them together.
    """
    said = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(key).alias("key"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), said.alias("_text")
    ).withColumn("digest", F.unhex(F.sha2("_text", 256)))
    head = ["key", "part", "digest"]
    listed = F.filter(F.split("_text", BLANKS), lambda w: w != "")
    short = rows.filter(F.length("_text") <= long_chars).withColumn("_words", listed)
    bits = _length_bits(F.col("_text"), F.size("_words"))
    mask = bits.bitwiseOR(_distinct_bit(F.size("_words"), F.size(F.array_distinct("_words"))))
    counted = short.select(*head, mask.alias("mask"))
    long_rows = rows.filter(F.length("_text") > long_chars)
    words = F.regexp_count("_text", F.lit(WORD.pattern))
    base = long_rows.withColumn("_n", words).select(*head, "_n", _length_bits(F.col("_text"), F.col("_n")).alias("_bits"))
    each = long_rows.select("digest", "_text").mapInArrow(_words, "digest binary, _words array<string>")
    spread = each.select("digest", F.explode("_words").alias("w")).distinct()
    distinct = spread.groupBy("digest").agg(F.count("*").alias("_d"))
    both = base.join(distinct, "digest", "left")
    mask = F.col("_bits").bitwiseOR(_distinct_bit(F.col("_n"), F.coalesce("_d", F.lit(0))))
    return counted.unionByName(both.select(*head, mask.alias("mask")))


def patterns(docs: DataFrame, labels: DataFrame, **names: object) -> DataFrame:
    """(part, mask, good, toxic, documents): how many documents of a part have the same bits, E among them, and labels.

    A row of no id has no smaller one and isn't E, nor do equal rows of one id
    make each other so. An id with several label rows is good, or toxic, if
    any of them says so; a document without labels is neither.
    """
    rows = flagged(docs, **names)
    first = rows.filter("key IS NOT NULL").groupBy("digest").agg(F.min("key").alias("first")).withColumnRenamed("digest", "of")
    # By digest and id: the copies of one text, however many, are spread by their ids.
    own = rows.join(first, (F.col("digest") == F.col("of")) & (F.col("key") == F.col("first")), "left")
    copy = F.col("key").isNotNull() & F.col("first").isNull()
    all_bits = own.select("key", "part", F.col("mask").bitwiseOR(_bit("E", copy)).alias("mask"))
    # Equal rows of one id become one before they meet the labels, so a hot id is a few rows.
    alike = all_bits.groupBy("key", "part", "mask").agg(F.count("*").alias("n"))
    says = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)))
    told = labels.groupBy(F.col("doc_id").alias("of")).agg(says("quality").alias("good"), says("toxic").alias("toxic"))
    said = [F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")]
    labelled = alike.join(told, F.col("key") == F.col("of"), "left").select("part", "mask", *said, "n")
    return labelled.groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("documents"))


def replayed(counted: DataFrame) -> DataFrame:
    """Every order over counted patterns: a row per part, order and step."""
    orders = counted.sparkSession.createDataFrame([(o,) for o in ORDERS], "filter_order string")
    crossed = counted.crossJoin(F.broadcast(orders))  # 120 rows, at any input size
    bits = F.create_map(*(F.lit(x) for letter in FILTERS for x in (letter, bit(letter))))
    fails = lambda letter: F.col("mask").bitwiseAND(bits[letter]) > 0
    first = F.coalesce(*(F.when(fails(F.substring("filter_order", s, 1)), s) for s in range(1, 6)))
    steps = crossed.withColumn("first", first).withColumn("step", F.explode(F.array(*map(F.lit, range(1, 6)))))
    letter = F.substring(F.col("filter_order"), F.col("step"), F.lit(1))
    at = steps.withColumn("letter", letter).withColumn("fails", fails(F.col("letter")))
    removed = F.coalesce(F.col("first") == F.col("step"), F.lit(False))
    count = lambda when: F.sum(F.when(when, F.col("documents")).otherwise(0))
    told = at.groupBy("part", "filter_order", "step", "letter").agg(
        count(F.col("first").isNull() | (F.col("first") > F.col("step"))).alias("kept"),
        count(removed).alias("removed"),
        count(F.col("fails") & (F.col("first") < F.col("step"))).alias("redundant"),
        count(F.col("mask") == bits[F.col("letter")]).alias("unique_fails"),
        count(removed & F.col("good")).alias("good_lost"),
        count(removed & F.col("toxic")).alias("toxic_lost"),
    )
    # 600 rows a part by now; each filter's removals over all orders go back to its rows.
    share = told.groupBy("part", "letter").agg(F.sum("removed").alias("shapley"))
    return told.join(share, ["part", "letter"]).drop("letter")


def audit(docs: DataFrame, labels: DataFrame, **names: object) -> DataFrame:
    """One row per part, order and step, zeros included: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    ``docs`` needs key, text and part columns, by name; others are left out, so
    they can't clash. Nulls: see ``flagged`` and ``patterns``. Repeated rows
    count each. An empty table has no parts and gives no rows.
    """
    return replayed(patterns(docs, labels, **names))


def op11_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, part, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
  min(doc_id) OVER (PARTITION BY t) AS smallest FROM d),
l AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
  concat(CASE WHEN len(ws) < 100 THEN 'A' END, CASE WHEN 100 * len(list_distinct(ws)) < 80 * len(ws) THEN 'B' END,
    CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN 'C' END,
    CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' END, CASE WHEN smallest < w.doc_id THEN 'E' END) AS failed
  FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
g AS (SELECT part, good, toxic, failed, count(*) AS n FROM f GROUP BY ALL),
o AS (SELECT '' AS filter_order UNION ALL
  SELECT filter_order || x FROM o, unnest(['A', 'B', 'C', 'D', 'E']) u(x) WHERE NOT contains(filter_order, x)),
s AS (SELECT part, good, toxic, failed, n, filter_order, step::INT AS step, filter_order[step] AS letter,
  len(list_filter(string_split(filter_order[:step - 1], ''), lambda x: x <> '' AND contains(failed, x))) > 0 AS gone
  FROM g, o, range(1, 6) r(step) WHERE length(filter_order) = 5),
q AS (SELECT part, filter_order, step, letter, sum(CASE WHEN NOT gone AND NOT contains(failed, letter) THEN n ELSE 0 END)::BIGINT AS kept,
  sum(CASE WHEN NOT gone AND contains(failed, letter) THEN n ELSE 0 END)::BIGINT AS removed,
  sum(CASE WHEN gone AND contains(failed, letter) THEN n ELSE 0 END)::BIGINT AS redundant,
  sum(CASE WHEN failed = letter THEN n ELSE 0 END)::BIGINT AS unique_fails,
  sum(CASE WHEN NOT gone AND contains(failed, letter) AND good THEN n ELSE 0 END)::BIGINT AS good_lost,
  sum(CASE WHEN NOT gone AND contains(failed, letter) AND toxic THEN n ELSE 0 END)::BIGINT AS toxic_lost
  FROM s GROUP BY part, filter_order, step, letter)
SELECT * EXCLUDE (letter), sum(removed) OVER (PARTITION BY part, letter)::BIGINT AS shapley FROM q
"""
