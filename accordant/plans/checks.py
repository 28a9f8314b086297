"""Queries of rules and accounts: misses and summaries, priors, retained frames, counts, resampled intervals and sequential sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from accordant import views
from accordant.operators import atoms, correlation, coupling, identity, monitor, ordering, statistics, traces
from accordant.plans import detectors
from accordant.plans.detectors import MODS, SHORT_DETECTOR
from accordant.schema import CODES

RETAINED, FIRST_TRACKS, REPLICATES, SEED = 100, 8, 200, 7


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def miss_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = lambda n, bad, good: F.when(F.col("l_partkey") % n == 0, bad).otherwise(good)
    reasons = F.array(*map(F.lit, (*monitor.MISS_REASONS, "other")))
    rows = _t(spark, sf_dir, "lineitem").select(
        every(37, F.lit(-1), F.col("l_orderkey")).alias("fusion_seq"),
        (F.col("l_orderkey") * 100).alias("fusion_timestamp_ms"),
        every(41, F.lit(0), F.lit(1)).alias("frame_id"),
        every(43, F.lit(0), F.lit(1)).alias("context_id"),
        every(47, F.lit(2**53), F.col("l_orderkey") + 1).alias("prior_id"),
        F.when(F.col("l_suppkey") % 9 == 0, -1).otherwise(F.col("l_suppkey")).alias("track_id"),
        F.element_at(reasons, (F.col("l_linenumber") % 6 + 1).cast("int")).alias("reason"),
    )
    return rows.groupBy(F.coalesce(monitor.miss_fault(), F.lit("sound")).alias("fault")).agg(F.count("*").alias("n_rows"))


def summary_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, customer = F.col("o_orderkey"), F.col("o_custkey")
    digest = F.sha2("o_orderpriority", 256)
    names = lambda *m: F.array(*map(F.lit, m))
    expected = F.when(customer % 13 == 0, F.array().cast("array<string>")).when(customer % 17 == 0, names("visual", "visual"))
    rows = _t(spark, sf_dir, "orders").select(
        key.alias("fusion_seq"),
        (key * 100).alias("fusion_timestamp_ms"),
        F.lit(1).alias("frame_id"),
        F.when(key % 53 == 0, 0).otherwise(1).alias("context_id"),
        (key + 1).alias("prior_id"),
        F.when(customer % 31 == 0, F.upper(digest)).otherwise(digest).alias("registry_digest"),
        expected.otherwise(names("visual", "radar")).alias("expected_modalities"),
        (customer % 70 * 1000).alias("active_track_count"),
        (key % 29 - 1).alias("input_count"),
        (customer % 11).alias("outcome_count"),
        (key % 7).alias("v1_expected_count"),
        (customer % 2 == 0).alias("degraded"),
        (key % 5 == 0).alias("truncated"),
    )
    return rows.groupBy(F.coalesce(monitor.summary_fault(), F.lit("sound")).alias("fault")).agg(F.count("*").alias("n_rows"))


def reused_priors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Priors of more than one frame, where every 31st frame has that of six frames before."""
    own = F.when((F.col("seq") % 31 == 0) & (F.col("seq") > 0), F.col("seq") - 5).otherwise(F.col("prior_id"))
    return correlation.prior_reuse(views.scenario(spark, sf_dir).withColumn("prior_id", own))


def retained_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correlation.retained(views.captured(spark, sf_dir), RETAINED).select("track_id", "seq", "modality", "timestamp_ms")


def realized_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces.realized_counts(views.captured(spark, sf_dir))


def mixed_origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generated and recorded rows together, with what each has of them."""
    rows = traces.labelled_union({"generated": views.scenario(spark, sf_dir), "recorded": views.captured(spark, sf_dir)})
    return rows.groupBy("origin", "track_id", "modality").agg(F.count("*").alias("n_rows"), F.countDistinct("seq").alias("n_frames"))


def ordered_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces.ordered(views.captured(spark, sf_dir)).select("track_id", "seq", "code", "timestamp_ms")


def first_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces.first_tracks(views.user_events(spark, sf_dir), FIRST_TRACKS)


def health_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each track: rows by what became of them, and how many of the admitted began a generation."""
    rows = ordering.checked(views.captured(spark, sf_dir), SHORT_DETECTOR, MODS)
    state = F.coalesce("reject", F.lit("admitted")).alias("state")
    return rows.groupBy("track_id", state).agg(F.count("*").alias("n_rows"), F.count_if("is_reset").alias("n_reset"))


SUITE = identity.suite_digest((SHORT_DETECTOR, detectors.SHORT_CORR), MODS)


def stream_bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the verdicts of each track of the capture are bound to: its admitted observations in order, and the parameters."""
    rows = ordering.checked(views.captured(spark, sf_dir), SHORT_DETECTOR, MODS).filter("reject IS NULL")
    return identity.bindings(rows, SUITE)


def alarm_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = detectors._reports(views.captured(spark, sf_dir), SHORT_DETECTOR, MODS)
    rank = statistics.alarm_rank(F.col("anomalous"), F.col("mean_nis") / 20)
    return rows.select("track_id", "modality", "seq", F.round(rank, 6).alias("rank"))


def auc_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AUC of two scores of toxic documents with percentile intervals over resamples, and of their paired difference."""
    rows = _t(spark, sf_dir, "labels").join(_t(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    rows = rows.withColumn("quality", F.col("quality").cast("double"))
    again = statistics.bootstrap_auc(rows, "doc_id", F.col("toxic") == 1, ("n_chars", "quality"), REPLICATES, SEED)
    wide = again.groupBy("replicate").agg(*(F.max(F.when(F.col("score") == s, F.col("auc"))).alias(s) for s in ("n_chars", "quality")))
    gap = wide.select(F.lit("difference").alias("score"), (F.col("n_chars") - F.col("quality")).alias("auc"))
    both = again.select("score", "auc").unionByName(gap).withColumn("auc", F.round("auc", 9))
    picks = {"low": statistics.rounded_rank(0.025), "high": statistics.rounded_rank(0.975)}
    out = statistics.picked_ranks(both, ["score"], "auc", picks)
    return out.select("score", F.col("n").alias("n_replicates"), F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


def label_atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What language and quality of documents say about toxicity, together and each alone, in bits."""
    rows = _t(spark, sf_dir, "labels").join(_t(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    out = atoms.atoms(rows, "lang", "quality", "toxic")
    return out.select(*((F.round(c, 9) + 0.0).alias(c) for c in atoms.ATOMS))


def sequential_cusums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of product and pointwise information of two channels, with each track's first third as reference."""
    pick = lambda m: F.max(F.when(F.col("modality") == m, F.col("p0")))
    pairs = views.scenario(spark, sf_dir).groupBy("track_id", "seq").agg(pick("visual").alias("x"), pick("acoustic").alias("y"))
    reference = F.col("seq") < F.floor(F.count("*").over(Window.partitionBy("track_id")) / 3)
    out = coupling.sequential_cusums(pairs, reference)
    return out.select("track_id", "seq", *(F.round(c, 5).alias(c) for c in ("product_cusum", "information_cusum")))


# SQL -----------------------------------------------------------------------


def _bindings_sql() -> str:
    """CTEs from gen to ``bound``; the bytes as hexadecimal text."""
    head = lambda name, kind, length: f"'{identity._prefix(name, kind, length).hex()}'"
    u64 = lambda name, x: f"{head(name, identity.U64, 8)} || format('{{:016x}}', ({x})::BIGINT)"
    u8 = lambda name, x: f"{head(name, identity.U8, 1)} || format('{{:02x}}', ({x})::BIGINT)"
    f64 = lambda name: f"{head(name, identity.F64, 8)} || hex(({name} + 0.0)::DOUBLE::BIT::BLOB)"
    domain = lambda name: f"'{identity._domain(name).hex()}'"
    code = "CASE modality " + " ".join(f"WHEN '{m}' THEN {CODES[m] + 1}" for m in MODS) + " END"
    there = [u8("projection", "1"), *(f64(c) for c in identity.PROJECTION), *(u64(c, c) for c in identity.PROVENANCE)]
    scalar = [domain("observation"), *(u64(c, c) for c in ("track_id", "timestamp_ms", "seq")), u8("modality", code), f64("nis"), u8("dof", "dof")]
    text = " || ".join([*scalar, f"CASE WHEN p0 IS NULL THEN {u8('projection', '0')} ELSE {' || '.join(there)} END"])
    levels, below = [], "l0"
    for step in range(identity.LEVELS):
        group = f"(nth - 1) // {identity.FAN_OUT}" if step < identity.LEVELS - 1 else "0"
        levels.append(f"""l{step + 1} AS (SELECT track_id, g + 1 AS nth, sha256(unhex({domain(f"level-{step}")} || {u64("count", "c")} || t)) AS d, n
  FROM (SELECT track_id, {group} AS g, count(*) AS c, string_agg(d, '' ORDER BY nth) AS t, sum(n)::BIGINT AS n FROM {below} GROUP BY ALL))""")
        below = f"l{step + 1}"
    suite = (identity._domain("binding") + identity._prefix("suite", identity.DIGEST, 32)).hex() + SUITE
    tree = head("tree", identity.DIGEST, 32)
    return f"""l0 AS (SELECT track_id, row_number() OVER (PARTITION BY track_id ORDER BY seq, code, timestamp_ms, dof, nis) AS nth, 1 AS n,
  sha256(unhex({text})) AS d FROM gen),
{", ".join(levels)},
bound AS (SELECT track_id, n, sha256(unhex('{suite}' || {u64("observations", "n")} || {tree} || d)) AS binding FROM {below})"""



_MISS = ", ".join(f"'{m}'" for m in (*monitor.MISS_REASONS, "other"))
_DRAWN = f"(replicate * 1000003 + d * 7919 + s * 104729 + {SEED}) % {statistics.DRAW_PRIME}"
_REFUSED = detectors.ORACLES["refused_rows"]

QUERIES = {
    "miss_rules": miss_rules,
    "summary_rules": summary_rules,
    "reused_priors": reused_priors,
    "retained_frames": retained_frames,
    "realized_counts": realized_counts,
    "mixed_origins": mixed_origins,
    "ordered_rows": ordered_rows,
    "first_tracks": first_tracks,
    "health_counts": health_counts, "stream_bindings": stream_bindings,
    "alarm_ranks": alarm_ranks,
    "auc_intervals": auc_intervals,
    "sequential_cusums": sequential_cusums, "label_atoms": label_atoms,
}

ORACLES = {
    "miss_rules": f"""SELECT CASE WHEN l_partkey % 37 = 0 THEN 'fusion_seq_out_of_range' WHEN l_partkey % 41 = 0 THEN 'frame_id_out_of_range'
  WHEN l_partkey % 43 = 0 THEN 'context_id_out_of_range' WHEN l_partkey % 47 = 0 THEN 'prior_id_out_of_range' WHEN l_suppkey % 9 = 0 THEN 'track_id_out_of_range'
  WHEN ([{_MISS}])[l_linenumber % 6 + 1] = 'other' THEN 'reason_unknown' ELSE 'sound' END AS fault, count(*) AS n_rows FROM lineitem GROUP BY ALL""",
    "summary_rules": """SELECT CASE WHEN o_orderkey % 53 = 0 THEN 'context_id_out_of_range' WHEN o_custkey % 31 = 0 THEN 'registry_digest_invalid'
  WHEN o_custkey % 70 > 65 THEN 'active_track_count_out_of_range' WHEN o_orderkey % 29 = 0 THEN 'input_count_out_of_range' WHEN o_orderkey % 7 > o_custkey % 11 THEN 'v1_over_outcomes'
  WHEN o_orderkey % 5 = 0 AND o_custkey % 2 <> 0 THEN 'truncated_but_not_degraded' WHEN o_custkey % 13 = 0 THEN 'expected_modalities_empty'
  WHEN o_custkey % 17 = 0 THEN 'expected_modality_repeated' ELSE 'sound' END AS fault, count(*) AS n_rows FROM orders GROUP BY ALL""",
    "reused_priors": f"""WITH {views.scenario_sql()}, p AS (SELECT DISTINCT track_id, seq, CASE WHEN seq % 31 = 0 AND seq > 0 THEN seq - 5 ELSE seq + 1 END AS prior_id FROM obs)
SELECT a.track_id, a.prior_id, 2::BIGINT AS n_frames, least(a.seq, b.seq) AS first_seq, greatest(a.seq, b.seq) AS last_seq FROM p a JOIN p b USING (track_id, prior_id) WHERE a.seq < b.seq""",
    "retained_frames": f"""WITH {views.captured_sql()}, s AS (SELECT DISTINCT track_id, seq FROM obs), k AS (SELECT track_id, seq FROM s QUALIFY row_number() OVER (PARTITION BY track_id ORDER BY seq DESC) <= {RETAINED})
SELECT track_id, seq, modality, timestamp_ms FROM obs SEMI JOIN k USING (track_id, seq)""",
    "realized_counts": f"""WITH {views.captured_sql()}, f AS (SELECT track_id, count(DISTINCT seq) AS n FROM obs GROUP BY 1)
SELECT track_id, modality, count(DISTINCT seq) AS observations, max(n) - count(DISTINCT seq) AS missing_frames FROM obs JOIN f USING (track_id) GROUP BY 1, 2""",
    "mixed_origins": f"""WITH g AS (WITH {views.scenario_sql()} SELECT 'generated' AS origin, track_id, modality, seq FROM obs),
r AS (WITH {views.captured_sql()} SELECT 'recorded' AS origin, track_id, modality, seq FROM obs)
SELECT origin, track_id, modality, count(*) AS n_rows, count(DISTINCT seq) AS n_frames FROM (FROM g UNION ALL FROM r) GROUP BY ALL""",
    "ordered_rows": f"WITH {views.captured_sql()} SELECT track_id, seq, code, timestamp_ms FROM obs ORDER BY track_id, seq, code",
    "first_tracks": f"WITH {views.user_events_sql()} SELECT DISTINCT track_id FROM obs ORDER BY track_id LIMIT {FIRST_TRACKS}",
    "health_counts": "WITH told AS (" + _REFUSED + "), kept AS (" + detectors.ORACLES["generations"] + """)
SELECT track_id, reject AS state, count(*) AS n_rows, 0::BIGINT AS n_reset FROM told GROUP BY ALL
UNION ALL SELECT track_id, 'admitted', count(*), count(*) FILTER (is_reset) FROM kept GROUP BY ALL""",
    "stream_bindings": detectors._captured_until(_bindings_sql()) + " SELECT track_id, n AS observations, binding FROM bound",
    "alarm_ranks": detectors._captured_until(detectors.reports_sql(SHORT_DETECTOR, 3))
    + " SELECT track_id, modality, seq, round(CASE WHEN anomalous THEN 2.0 ELSE 0.0 END + greatest(0.0, least(1.0, mean_nis / 20)), 6) AS rank FROM rep",
    "auc_intervals": f"""WITH l AS (SELECT doc_id, toxic = 1 AS pos, n_chars::DOUBLE AS n_chars, quality::DOUBLE AS quality FROM labels JOIN documents USING (doc_id)),
h AS (SELECT r.replicate, doc_id, pos, n_chars, quality, {_DRAWN.replace("d *", f"(doc_id % {statistics.DRAW_PRIME}) *").replace("s *", "0 *")} AS h FROM l, range({REPLICATES}) r(replicate)),
d AS (SELECT *, (((h * h + 12345) % {statistics.DRAW_PRIME}) * ((h * h + 12345) % {statistics.DRAW_PRIME}) + h) % {statistics.DRAW_PRIME} AS u FROM h),
z AS (SELECT *, unnest(range(list_sum(list_transform({statistics.poisson_cuts()}, lambda c: (u >= c)::INT))::INT)) AS again FROM d),
x AS (SELECT z.replicate, z.pos, v.score, v.value FROM z, LATERAL (VALUES ('n_chars', z.n_chars), ('quality', z.quality)) v(score, value)),
m AS (SELECT replicate, score, pos, rank() OVER w + (count(*) OVER (PARTITION BY replicate, score, value) - 1) / 2 AS mid FROM x WINDOW w AS (PARTITION BY replicate, score ORDER BY value)),
a AS (SELECT replicate, score, round((sum(mid) FILTER (pos) - count(*) FILTER (pos) * (count(*) FILTER (pos) + 1) / 2) / (count(*) FILTER (pos)::DOUBLE * count(*) FILTER (NOT pos)), 12) AS auc FROM m GROUP BY ALL),
e AS (SELECT score, auc FROM a UNION ALL SELECT 'difference', b.auc - c.auc FROM a b JOIN a c USING (replicate) WHERE b.score = 'n_chars' AND c.score = 'quality'),
o AS (SELECT score, list_sort(list(round(auc, 9))) AS v, count(*) AS n FROM e GROUP BY score)
SELECT score, n AS n_replicates, round(v[floor(0.025 * (n - 1) + 0.5)::INT + 1], 6) AS low, round(v[floor(0.975 * (n - 1) + 0.5)::INT + 1], 6) AS high FROM o""",
    # by self-joins of the cells: each cell with all cells of its x, of its y and of its target
    "label_atoms": """WITH c AS (SELECT coalesce(lang, '-') AS x, coalesce(quality, -1) AS y, coalesce(toxic, -1) AS t, count(*)::DOUBLE AS c FROM labels JOIN documents USING (doc_id) GROUP BY ALL),
p AS (SELECT a.x, a.y, a.t, a.c, sum(b.c) AS n, sum(b.c) FILTER (b.t = a.t) AS nt, sum(b.c) FILTER (b.x = a.x) AS nx, sum(b.c) FILTER (b.y = a.y) AS ny,
  sum(b.c) FILTER (b.x = a.x AND b.t = a.t) AS nxt, sum(b.c) FILTER (b.y = a.y AND b.t = a.t) AS nyt, sum(b.c) FILTER (b.x = a.x AND b.y = a.y) AS nxy,
  sum(b.c) FILTER (b.x = a.x OR b.y = a.y) AS ne, sum(b.c) FILTER ((b.x = a.x OR b.y = a.y) AND b.t = a.t) AS net FROM c a, c b GROUP BY ALL),
i AS (SELECT sum(c / n * log2(nxt * n / nx / nt)) AS ix, sum(c / n * log2(nyt * n / ny / nt)) AS iy, sum(c / n * log2(c * n / nxy / nt)) AS ixy, sum(c / n * log2(net * n / ne / nt)) AS r FROM p)
SELECT round(ix, 9) + 0.0 AS i_x, round(iy, 9) + 0.0 AS i_y, round(ixy, 9) + 0.0 AS i_xy, round(r, 9) + 0.0 AS redundancy, round(ix - r, 9) + 0.0 AS unique_x, round(iy - r, 9) + 0.0 AS unique_y, round(ixy - ix - iy + r, 9) + 0.0 AS synergy FROM i""",
    # the recursion itself, row by row
    "sequential_cusums": f"""WITH RECURSIVE {views.scenario_sql()}, w AS (SELECT track_id, seq, max(p0) FILTER (modality = 'visual') AS x, max(p0) FILTER (modality = 'acoustic') AS y FROM obs GROUP BY ALL),
n AS (SELECT track_id, floor(count(*) / 3) AS ref FROM w GROUP BY 1),
c AS (SELECT track_id, avg(x) AS mx, stddev_pop(x) AS sx, avg(y) AS my, stddev_pop(y) AS sy FROM w JOIN n USING (track_id) WHERE seq < ref GROUP BY 1),
z AS (SELECT track_id, seq, seq < ref AS cal, (x - mx) / sx AS a, (y - my) / sy AS b FROM w JOIN n USING (track_id) JOIN c USING (track_id)),
q AS (SELECT track_id, avg(a * b) AS r FROM z WHERE cal GROUP BY 1),
i AS (SELECT z.*, a * b AS pr, -0.5 * ln(1 - r * r) - (r * r * (a * a + b * b) - 2 * r * a * b) / (2 * (1 - r * r)) AS inf FROM z JOIN q USING (track_id)),
f AS (SELECT track_id, avg(pr) AS mp, stddev_pop(pr) AS sp, avg(inf) AS mi, stddev_pop(inf) AS si FROM i WHERE cal GROUP BY 1),
g AS MATERIALIZED (SELECT track_id, seq, row_number() OVER (PARTITION BY track_id ORDER BY seq) AS k, (mp - pr) / sp - {coupling.SEQ_SLACK!r} AS up, (mi - inf) / si - {coupling.SEQ_SLACK!r} AS ui FROM i JOIN f USING (track_id) WHERE NOT cal),
run AS (SELECT track_id, seq, k, greatest(0, up) AS sp, greatest(0, ui) AS si FROM g WHERE k = 1
  UNION ALL SELECT g.track_id, g.seq, g.k, greatest(0, run.sp + g.up), greatest(0, run.si + g.ui) FROM run JOIN g ON g.track_id = run.track_id AND g.k = run.k + 1)
SELECT track_id, seq, round(sp, 5) AS product_cusum, round(si, 5) AS information_cusum FROM run""",
}
