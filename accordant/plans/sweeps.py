"""Sweeps of how far the spoofed channel is decoupled: detection by depth, the evasion ceiling, and depth scores, all depths in one pass."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from accordant import views
from accordant.operators import fusion, statistics, traces
from accordant.plans import detectors
from accordant.plans.detectors import CORR, DETECTOR, MODS

GRID = (0.0, 0.25, 0.5, 0.75, 1.0)
#: A detection share up to which a depth counts as evading.
EVADES = 0.10


def swept(spark: SparkSession, sf_dir: str, grid: tuple[float, ...] = GRID) -> DataFrame:
    """The scenario once for each depth: tracks of depth i have ids from 1000 i on."""
    depths = F.array(*(F.struct(F.lit(i).cast("long").alias("i"), F.lit(d).alias("d")) for i, d in enumerate(grid)))
    v = views._vectors(spark, sf_dir).select("*", F.explode(depths).alias("g")).withColumn("track_id", F.col("track_id") + 1_000 * F.col("g.i"))
    rows = None
    for m in views.CHANNELS:
        code = views.CODES[m]

        def coordinate(a: int, m: str = m, code: int = code) -> Column:
            at = lambda i: F.col("_v")[i].cast("double")
            latent = at(views.LATENT_AT + a)
            if m == views.SPOOFED:
                mixed = F.sqrt(1 - F.col("g.d")) * latent + F.sqrt("g.d") * at(views.PHANTOM_AT + a)
                latent = F.when(F.col("seq") >= F.floor(F.col("_len") / 3), mixed).otherwise(latent)
            return views.SCALE * (math.sqrt(views.RHO) * latent + math.sqrt(1 - views.RHO) * at(3 * code + a))

        part = v.select("track_id", "seq", (F.col("seq") * views.DT_MS + code).alias("timestamp_ms"), F.lit(m).alias("modality"), F.lit(code).alias("code"), *(coordinate(a).alias(f"p{a}") for a in range(3)), F.lit(1).cast("long").alias("frame_id"), F.lit(1).cast("long").alias("context_id"), (F.col("seq") + 1).alias("prior_id"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.withColumns({"nis": F.col("p0") * F.col("p0") + F.col("p1") * F.col("p1") + F.col("p2") * F.col("p2"), "dof": F.lit(3)})


def swept_sql(grid: tuple[float, ...] = GRID) -> str:
    depths = ", ".join(f"({i}, {d!r}::DOUBLE)" for i, d in enumerate(grid))
    values = ", ".join(f"('{m}', {views.CODES[m]})" for m in views.CHANNELS)

    def coordinate(a: int) -> str:
        latent, phantom = f"CAST(v[{views.LATENT_AT + a + 1}] AS DOUBLE)", f"CAST(v[{views.PHANTOM_AT + a + 1}] AS DOUBLE)"
        shared = f"CASE WHEN m.modality = '{views.SPOOFED}' AND seq >= floor(len / 3) THEN sqrt(1 - g.d) * {latent} + sqrt(g.d) * {phantom} ELSE {latent} END"
        return f"{views.SCALE} * ({math.sqrt(views.RHO)!r} * ({shared}) + {math.sqrt(1 - views.RHO)!r} * CAST(v[3 * m.code + {a + 1}] AS DOUBLE)) AS p{a}"

    return f"""vec AS (SELECT vec_id // {views.TRACK_FRAMES} AS track_id, row_number() OVER (PARTITION BY vec_id // {views.TRACK_FRAMES} ORDER BY vec_id) - 1 AS seq, count(*) OVER (PARTITION BY vec_id // {views.TRACK_FRAMES}) AS len, embedding AS v FROM embeddings),
raw AS (SELECT track_id + 1000 * g.i AS track_id, seq, seq * {views.DT_MS} + m.code AS timestamp_ms, m.modality, m.code, {", ".join(map(coordinate, range(3)))} FROM vec, (VALUES {values}) m(modality, code), (VALUES {depths}) g(i, d)),
obs AS (SELECT *, p0 * p0 + p1 * p1 + p2 * p2 AS nis, 3 AS dof, 1 AS frame_id, 1 AS context_id, seq + 1 AS prior_id FROM raw)"""


def _assessed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fusion.assessed_frames(swept(spark, sf_dir), MODS, DETECTOR, CORR)
    depth = F.element_at(F.array(*map(F.lit, GRID)), (F.floor(F.col("track_id") / 1_000) + 1).cast("int"))
    # Only windows that lie after the onset in full.
    return rows.withColumn("d", depth).withColumn("_n", F.count("*").over(_track())).filter(F.col("seq") >= F.floor(F.col("_n") / 3) + CORR.window)


def _track():  # noqa: ANN202
    from pyspark.sql import Window

    return Window.partitionBy("track_id")


def _shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    alert = F.col("fused_verdict").isin(*traces.ALERTS)
    named = (F.col("fused_verdict") == "attributed") & (F.col("fused_channels") == views.SPOOFED)
    return _assessed(spark, sf_dir).groupBy("d").agg(F.count("*").alias("n_frames"), F.count_if(alert).alias("n_alert"), F.count_if(named).alias("n_named"))


def decoupling_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    low, high = statistics.wilson(F.col("n_alert"), F.col("n_frames"))
    return _shares(spark, sf_dir).select("d", "n_frames", "n_alert", "n_named", F.round(F.col("n_alert") / F.col("n_frames"), 6).alias("share"), F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


def evasion_ceiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest depth whose detection share is at most EVADES; 0 if none."""
    share = F.col("n_alert") / F.col("n_frames")
    return _shares(spark, sf_dir).agg(F.coalesce(F.max(F.when(share <= EVADES, F.col("d"))), F.lit(0.0)).alias("ceiling"))


def depth_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decoupling depth, 1 less the weakest over the strongest corroboration of a channel on axis 0, as a score of each depth against none."""
    rows = _assessed(spark, sf_dir)
    best = [F.greatest(F.col(f"r_0_{min(i, j)}_{max(i, j)}"), F.col(f"r_0_{min(i, k)}_{max(i, k)}")) for i, j, k in ((0, 1, 2), (1, 0, 2), (2, 0, 1))]
    depth = F.when(F.greatest(*best) > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.least(*best) / F.greatest(*best)))).otherwise(0.0)
    scored = rows.select("d", F.round(depth, 6).alias("score"))
    none = scored.filter("d = 0").select("score", F.explode(F.array(*map(F.lit, GRID[1:]))).alias("d"), F.lit(False).alias("positive"))
    both = scored.filter("d > 0").select("score", "d", F.lit(True).alias("positive")).unionByName(none)
    return statistics.auc(both, ["d"], "score", F.col("positive")).select("d", "n_pos", "n_neg", F.round("auc", 4).alias("auc"))


_SQL = "WITH RECURSIVE " + ",\n".join((swept_sql(), detectors.generation_sql(DETECTOR), detectors.reports_sql(DETECTOR, 3), detectors.verdict_sql(DETECTOR, 3), detectors.frames_sql(DETECTOR), detectors.pairs_sql(CORR), detectors.axes_sql(CORR)))
_SQL += f""", nf AS (SELECT track_id, count(*) AS n FROM fused GROUP BY track_id),
late AS (SELECT f.*, ([{", ".join(map(repr, GRID))}])[(track_id // 1000 + 1)::INT] AS d FROM fused f JOIN nf USING (track_id) WHERE seq >= floor(n / 3) + {CORR.window}),
sh AS (SELECT d, count(*) AS n_frames, count(*) FILTER (fused_verdict IN ('attributed', 'broad', 'unclassified')) AS n_alert, count(*) FILTER (fused_verdict = 'attributed' AND fused_channels = '{views.SPOOFED}') AS n_named FROM late GROUP BY d)"""


def _wilson(bound: str) -> str:
    from accordant.functions.special import Z95

    z2, p = f"{Z95 * Z95!r}", "(n_alert::DOUBLE / n_frames)"
    centre, half = f"(({p} + {z2} / 2 / n_frames) / (1 + {z2} / n_frames))", f"({Z95!r} * sqrt({p} * (1 - {p}) / n_frames + {z2} / 4 / n_frames / n_frames) / (1 + {z2} / n_frames))"
    return f"round(greatest(0, {centre} - {half}), 6)" if bound == "low" else f"round(least(1, {centre} + {half}), 6)"


QUERIES = {"decoupling_sweep": decoupling_sweep, "evasion_ceiling": evasion_ceiling, "depth_auc": depth_auc}

ORACLES = {
    "decoupling_sweep": _SQL + f" SELECT d::DOUBLE AS d, n_frames, n_alert, n_named, round(n_alert / n_frames, 6) AS share, {_wilson('low')} AS low, {_wilson('high')} AS high FROM sh",
    "evasion_ceiling": _SQL + f" SELECT coalesce(max(d) FILTER (n_alert / n_frames <= {EVADES}), 0.0)::DOUBLE AS ceiling FROM sh",
    "depth_auc": _SQL + """, b AS (SELECT l.d, greatest(r_0_0_1, r_0_0_2) AS b0, greatest(r_0_0_1, r_0_1_2) AS b1, greatest(r_0_0_2, r_0_1_2) AS b2 FROM late l JOIN pc USING (track_id, generation, seq)),
s AS (SELECT d::DOUBLE AS d, round(CASE WHEN greatest(b0, b1, b2) > 0 THEN greatest(0, least(1, 1 - least(b0, b1, b2) / greatest(b0, b1, b2))) ELSE 0 END, 6) AS score FROM b)
SELECT p.d, count(DISTINCT p.k) AS n_pos, count(DISTINCT n.k) AS n_neg, round(sum(CASE WHEN p.score > n.score THEN 1 WHEN p.score = n.score THEN 0.5 ELSE 0 END) / count(*), 4)::DOUBLE AS auc
FROM (SELECT *, row_number() OVER () AS k FROM s WHERE d > 0) p, (SELECT *, row_number() OVER () AS k FROM s WHERE d = 0) n GROUP BY p.d""",
}
