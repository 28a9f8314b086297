"""Study statistics as aggregates: ranks over distinct values, entropies, intervals. Partial sums come before each exchange."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from accordant.functions.special import Z95


def auc(rows: DataFrame, group: list[str], score: str, positive: Column) -> DataFrame:
    """Mann-Whitney AUC with half credit for ties; null where a class is empty. Null scores are left out."""
    counts = rows.filter(F.col(score).isNotNull()).groupBy(*group, score).agg(F.count_if(positive).alias("_p"), F.count_if(~positive).alias("_n"))
    return _auc_of_counts(counts, group, score)


def _auc_of_counts(counts: DataFrame, group: list[str], score: str) -> DataFrame:
    """AUC from positives ``_p`` and negatives ``_n`` of each distinct score."""
    below = F.sum("_n").over(Window.partitionBy(*group).orderBy(score).rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")
    won = counts.withColumn("_won", F.col("_p") * (below + F.col("_n") / 2))
    return won.groupBy(*group).agg(F.sum("_p").alias("n_pos"), F.sum("_n").alias("n_neg"), F.sum("_won").alias("_won")).withColumn("auc", F.try_divide("_won", F.col("n_pos").cast("double") * F.col("n_neg"))).drop("_won")


def entropies(rows: DataFrame, x: str, y: str) -> DataFrame:
    """One row: plug-in entropies h_x, h_y, h_xy and mutual information mi, in bits. Nulls are a label of their own."""
    def h(*columns: str) -> DataFrame:
        counts = rows.groupBy(*columns).agg(F.count("*").alias("c"))
        # log2(n) - sum(c log2 c) / n; one row a label before this sum.
        return counts.agg((F.log2(F.sum("c")) - F.sum(F.col("c") * F.log2("c")) / F.sum("c")).alias("h"))

    a, b, ab = h(x), h(y), h(x, y)
    one = a.withColumnRenamed("h", "h_x").crossJoin(b.withColumnRenamed("h", "h_y")).crossJoin(ab.withColumnRenamed("h", "h_xy"))
    return one.withColumn("mi", F.col("h_x") + F.col("h_y") - F.col("h_xy"))


def wilson(successes: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    p = F.try_divide(successes, n)
    centre = (p + z * z / 2 / n) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / 4 / n / n) / (1 + z * z / n)
    return F.greatest(F.lit(0.0), centre - half), F.least(F.lit(1.0), centre + half)


def hoeffding(mean: Column, n: Column, low: float, high: float, alpha: float = 0.05) -> tuple[Column, Column]:
    half = (high - low) * F.sqrt(math.log(2 / alpha) / (2 * n))
    return F.greatest(F.lit(low), mean - half), F.least(F.lit(high), mean + half)


def picked_ranks(rows: DataFrame, group: list[str], value: str, picks: dict[str, Column]) -> DataFrame:
    """Order statistics: each pick is an index from 0 in terms of the count ``n``. Only distinct values are ranked."""
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("_c"))
    w = Window.partitionBy(*group)
    ranked = counts.withColumns({"n": F.sum("_c").over(w), "_upto": F.sum("_c").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))})
    return ranked.groupBy(*group).agg(F.max("n").alias("n"), *(F.min(F.when(F.col("_upto") > at, F.col(value))).alias(name) for name, at in picks.items()))


#: The rules by which the reports pick an order statistic; they differ.
def nearest_rank(percent: int) -> Column:
    return F.ceil(F.col("n") * percent / 100) - 1


def floor_rank(q: float) -> Column:
    return F.floor(q * (F.col("n") - 1))


def rounded_rank(q: float) -> Column:
    return F.floor(q * (F.col("n") - 1) + 0.5)


def lower_median() -> Column:
    return F.floor((F.col("n") - 1) / 2)


def upper_median() -> Column:
    return F.floor(F.col("n") / 2)


def alarm_rank(alarm: Column, score: Column) -> Column:
    """A score clamped to 0 to 1, above all others where there is an alarm."""
    clamped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))
    return F.when(alarm, 2.0 + clamped).otherwise(clamped)


#: The modulus of the draws, a prime (a fixed value).
DRAW_PRIME = 2_147_483_647


def drawn(replicate: Column, draw: Column, stratum: Column, n: Column, seed: int = 7) -> Column:
    """A number from 0 to ``n - 1``, told by its arguments alone: two squarings modulo a prime."""
    h = (replicate * 1_000_003 + draw * 7_919 + stratum * 104_729 + seed) % DRAW_PRIME
    again = (h * h + 12_345) % DRAW_PRIME
    return (again * again + h) % DRAW_PRIME % n


def poisson_cuts(n: int = 12) -> list[int]:
    """Draws from which on a row counts once, twice and so on: the distribution function of a Poisson number of mean 1."""
    total, cuts = 0.0, []
    for k in range(n):
        total += math.exp(-1) / math.factorial(k)
        cuts.append(math.ceil(total * DRAW_PRIME))
    return cuts


def bootstrap_auc(rows: DataFrame, key: str, positive: Column, scores: tuple[str, ...], replicates: int = 200, seed: int = 7) -> DataFrame:
    """One row a (replicate, score): the AUC of a resample in which each row counts a Poisson number of times, of mean 1.

    That number is told by replicate and key (a whole number) alone, where the
    row is: no row needs a place among the others and none is joined or
    shuffled; counts of equal scores are summed before they are. All scores of
    a replicate share its numbers, so their differences are paired. Rows of one
    key count alike; a null key counts as 0. Null scores are left out.
    """
    values = F.array(*(F.struct(F.lit(s).alias("name"), F.col(s).cast("double").alias("value")) for s in scores))
    known = rows.select(positive.alias("_pos"), F.pmod(F.coalesce(F.col(key).cast("long"), F.lit(0)), F.lit(DRAW_PRIME)).alias("_d"), values.alias("_v"))
    each = known.withColumn("replicate", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(replicates - 1).cast("long"))))
    u = drawn(F.col("replicate"), F.col("_d"), F.lit(0), F.lit(DRAW_PRIME), seed)
    cuts = F.array(*(F.lit(c).cast("long") for c in poisson_cuts()))
    told = each.select("replicate", "_pos", u.alias("_u"), "_v").withColumn("_times", F.size(F.filter(cuts, lambda c: F.col("_u") >= c)))
    long = told.filter("_times > 0").select("replicate", "_pos", "_times", F.explode("_v").alias("v")).filter("v.value IS NOT NULL")
    of = lambda holds: F.sum(F.when(holds, F.col("_times")).otherwise(0))
    counts = long.groupBy("replicate", F.col("v.name").alias("score"), F.col("v.value").alias("value")).agg(
        of(F.col("_pos")).alias("_p"), of(~F.col("_pos")).alias("_n")
    )
    return _auc_of_counts(counts, ["replicate", "score"], "value")
