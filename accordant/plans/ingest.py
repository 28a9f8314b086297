"""Queries of admission, monitor rules, ledgers, registry, authority and injections, over rows derived from the test tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from accordant import views
from accordant.operators import admission, authority, injection, ledger, monitor
from accordant.operators.registry import Registry, bind
from accordant.schema import MODALITIES


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def admitted_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scalar admission of events with broken values here and there, counted by reason."""
    e = _t(spark, sf_dir, "events")
    bad = lambda n, k: F.col("event_id") % n == k
    rows = e.select(
        F.when(bad(97, 1), -1).otherwise(F.col("user_id")).alias("track_id"), F.when(bad(101, 2), F.lit(2**53)).otherwise(F.unix_millis(F.col("ts").cast("timestamp"))).alias("timestamp_ms"), F.when(bad(103, 3), F.lit(None)).otherwise(F.col("event_id")).alias("seq"),
        F.when(bad(107, 4), "sonar").otherwise(F.lit(MODALITIES[0])).alias("modality"), F.when(bad(109, 5), float("nan")).when(bad(113, 6), float("inf")).when(bad(127, 7), -F.col("value") - 1).otherwise(F.col("value")).alias("nis"), F.when(bad(131, 8), 0).otherwise(3).alias("dof"),
    )
    return admission.admit(rows, admission.scalar_rules()).groupBy(F.coalesce("reject_reason", F.lit("admitted")).alias("reason")).agg(F.count("*").alias("n_rows"))


def admitted_covariances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Covariance admission and symmetrisation of matrices from vectors."""
    v = lambda i: F.col("embedding")[i].cast("double")
    skew = F.when(F.col("vec_id") % 7 == 0, 1e-3).otherwise(0.0)
    cov = F.array(F.array(v(0) + 0.1, v(1), v(2)), F.array(v(1) + skew, v(3) + 0.2, v(4)), F.array(v(2), v(4), v(5) + 0.2))
    rows = _t(spark, sf_dir, "embeddings").select("vec_id", cov.alias("cov"))
    out = rows.withColumn("reason", admission.first_broken(admission.covariance_rules(F.col("cov"))))
    return out.select("vec_id", F.coalesce("reason", F.lit("admitted")).alias("reason"), F.round(F.when(F.col("reason").isNull(), admission.symmetrised(F.col("cov"))[0][1]), 6).alias("c01"))


def admitted_projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projection admission: dimensions, padding and identities."""
    v = lambda i: F.col("embedding")[i].cast("double")
    dims = (F.col("vec_id") % 5).cast("int")
    p = F.struct(F.array(v(0), F.when(dims >= 2, v(1)).otherwise(0.0), F.when((dims >= 3) | (F.col("vec_id") % 11 == 0), v(2)).otherwise(0.0)).alias("values"), dims.alias("dimensions"), F.lit(1).cast("long").alias("frame_id"), (F.col("vec_id") % 13).alias("context_id"), F.lit(1).cast("long").alias("prior_id"))
    rows = _t(spark, sf_dir, "embeddings").select(p.alias("p"))
    return rows.select(F.coalesce(admission.first_broken(admission.projection_rules(F.col("p"))), F.lit("admitted")).alias("reason")).groupBy("reason").agg(F.count("*").alias("n_rows"))


def session_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The identifier grammar over document sources and page addresses."""
    names = _t(spark, sf_dir, "documents").select(F.col("source").alias("name")).unionAll(_t(spark, sf_dir, "pages").select("url")).unionAll(_t(spark, sf_dir, "pages").select(F.regexp_replace("url", "^https?://|[/?#].*$", "")))
    return names.groupBy(F.coalesce(admission.valid_identifier(F.col("name")), F.lit(False)).alias("valid")).agg(F.count("*").alias("n_names"), F.countDistinct("name").alias("n_different"))


def heartbeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heartbeat rules over events as heartbeats."""
    c = lambda n: F.col("event_id") % n
    rows = _t(spark, sf_dir, "events").select(
        F.unix_millis(F.col("ts").cast("timestamp")).alias("producer_timestamp_ms"), F.col("event_id").alias("uptime_ms"), (c(41) * 10).alias("declared_interval_ms"), (400 - c(13)).alias("declared_deadline_ms"), F.col("user_id").alias("active_track_count"), (c(2) == 0).alias("degraded"),
        (c(53)).alias("capacity"), (c(59) - 10).alias("depth"), F.when(c(3) == 0, 1).otherwise(0).cast("long").alias("dropped"), F.col("event_id").alias("published"),
    )
    return rows.groupBy(F.coalesce(monitor.heartbeat_fault(), F.lit("sound")).alias("reason")).agg(F.count("*").alias("n_rows"))


def _outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = _t(spark, sf_dir, "lineitem")  # noqa: E741
    modality = F.element_at(F.array(F.lit("visual"), F.lit("acoustic"), F.lit("radar")), (F.col("l_linenumber") % 3 + 1).cast("int"))
    rows = l.select(
        F.col("l_orderkey").alias("fusion_seq"), F.when(F.col("l_orderkey") % 3 == 0, F.col("l_suppkey") % 2).otherwise(0).alias("track_id"), modality.alias("modality"), F.col("l_linenumber"), F.col("l_partkey"), F.col("l_quantity").alias("projection"),
        F.when(F.col("l_returnflag") == "A", "updated").when(F.col("l_returnflag") == "N", "gate_rejected").otherwise("update_rejected").alias("outcome"), (F.col("l_returnflag") == "A").alias("v1_expected"), F.lit(4).alias("candidate_count"), (2 + (F.col("l_partkey") % 31 == 0).cast("int")).alias("in_gate_count"),
        (F.col("l_orderkey") * 100).alias("fusion_timestamp_ms"), (F.col("l_linenumber") - 1).alias("measurement_index"), (F.col("l_discount") * 100).alias("d2"), F.lit(5.5).alias("threshold"),
    )
    own = Window.partitionBy(*ledger.PAIR).orderBy("l_linenumber")
    return rows.withColumn("attempt_index", F.row_number().over(own) - 1 + (F.col("l_partkey") % 29 == 0).cast("int"))


def outcome_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _outcomes(spark, sf_dir).withColumns({"frame_id": F.lit(1), "context_id": F.lit(1), "prior_id": F.col("fusion_seq") + 1, "has_projection": F.col("l_partkey") % 10 != 0, "in_gate_count": F.col("in_gate_count") * (F.col("l_partkey") % 9 != 0).cast("int")})
    return rows.groupBy("outcome", F.coalesce(monitor.outcome_fault(), F.lit("sound")).alias("reason")).agg(F.count("*").alias("n_rows"))


def ledger_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcomes = _outcomes(spark, sf_dir)
    counts = _t(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("fusion_seq")).agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "A").alias("v1"))
    summaries = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("fusion_seq"), "o_custkey").join(counts, "fusion_seq", "left").select(
        "fusion_seq", (F.coalesce("n", F.lit(0)) + (F.col("fusion_seq") % 17 == 0).cast("int")).alias("outcome_count"), (F.coalesce("v1", F.lit(0)) + (F.col("o_custkey") % 19 == 0).cast("int")).alias("v1_expected_count"), (F.col("o_custkey") % 5 == 0).cast("int").alias("_extra"),
        F.when(F.col("o_custkey") % 23 == 0, F.array(F.lit("visual"), F.lit("radar"))).otherwise(F.array(F.lit("visual"), F.lit("acoustic"), F.lit("radar"))).alias("expected_modalities"),
    ).withColumn("active_track_count", 1 + F.col("_extra"))
    return ledger.reconcile(outcomes, summaries).select("fusion_seq", "received", "v1_received", "n_tracks", F.coalesce("fault", F.lit("sound")).alias("fault"))


#: What tells the measurements of a frame's channel apart.
MEASURED = (*ledger.PAIR, "measurement_index")


def _observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = F.col("l_partkey")
    return _outcomes(spark, sf_dir).filter((F.col("v1_expected") & (part % 23 != 0)) | ((F.col("outcome") == "gate_rejected") & (part % 43 == 0))).select(
        *MEASURED, (F.col("fusion_timestamp_ms") + (part % 37 == 0).cast("int")).alias("timestamp_ms"), (F.col("projection") + (part % 41 == 0).cast("int")).alias("projection")
    )


def joined_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every outcome against every observation; a pair has several measurements, so these are told apart by their index."""
    return ledger.join_observations(_outcomes(spark, sf_dir), _observed(spark, sf_dir), MEASURED)


def unprojected_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected channels of frozen tracks without a projected observation."""
    expected = _t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("track_id"), F.explode(F.array(*(F.lit(m) for m in MODALITIES[:3]))).alias("modality"))
    seen = _t(spark, sf_dir, "lineitem").filter("l_quantity > 48").select(F.col("l_suppkey").alias("track_id"), F.element_at(F.array(*(F.lit(m) for m in MODALITIES[:3])), (F.col("l_linenumber") % 3 + 1).cast("int")).alias("modality"), F.when(F.col("l_tax") > 0.02, F.col("l_quantity")).alias("projection"))
    frozen = _t(spark, sf_dir, "supplier").filter("s_nationkey < 12").select(F.col("s_suppkey").alias("track_id"))
    return ledger.only_frozen(ledger.unprojected(expected, seen), frozen)


def _interval(low: int, high: int | None) -> dict:
    return {"valid_from_timestamp_ms": low, "valid_until_timestamp_ms": high}


#: A registry of two frames and three contexts, with one open end.
REGISTRY = json.dumps(
    {
        "frames": [{"frame_id": 1, "applicability": _interval(0, None)}, {"frame_id": 2, "applicability": _interval(10_000, 30_000)}],
        "contexts": [
            {"context_id": c, "frame_id": f, "applicability": _interval(lo, hi), "expected_modalities": [{"modality": m} for m in mods]}
            for c, f, lo, hi, mods in ((1, 1, 0, 12_000, ("visual", "acoustic", "radar")), (2, 1, 5_000, None, ("visual", "radar")), (3, 2, 8_000, 40_000, ("visual", "acoustic")))
        ],
    }
)


def registry_binding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.scenario(spark, sf_dir).withColumn("context_id", F.col("seq") % 5).withColumn("frame_id", F.when(F.col("seq") % 7 == 0, 2).otherwise(F.when(F.col("context_id") == 3, 2).otherwise(1)))
    return bind(rows.select("track_id", "seq", "modality", "timestamp_ms", "frame_id", "context_id"), Registry.from_json(REGISTRY).contexts(spark))


def authority_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consecutive orders of a customer as policies before and after a finding."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    snap = F.struct(
        F.when(F.col("o_orderstatus") == "F", "deny").otherwise("allow").alias("authorization"), (F.col("o_orderkey") % 3).alias("velocity_limit_units"), (F.col("o_orderkey") % 2).alias("slew_limit_units"), F.lit(5).alias("command_ttl_ms"), (F.col("o_orderkey") % 4).alias("lease_expiry_ms"),
        (F.col("o_orderkey") % 11 == 0).cast("int").alias("watchdog_epoch"), F.when(F.col("o_orderkey") % 13 == 0, "b").otherwise("a").alias("capability_digest"),
    )
    rows = _t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", snap.alias("after")).withColumn("before", F.lag("after").over(w)).filter(F.col("before").isNotNull())
    policy = F.when(F.col("o_custkey") % 4 == 0, "record_only").otherwise("restrict_only")
    return rows.select("o_orderkey", F.coalesce(authority.violation(policy), F.lit("allowed")).alias("violation"))


def _research(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.scenario(spark, sf_dir)
    return rows.withColumns({f"y{i}": F.col(f"p{i}") for i in range(3)} | dict(zip(injection.COVARIANCE, map(F.lit, (1.0, 0.1, 0.0, 1.5, 0.2, 2.0)), strict=True)))


INJECTIONS = {"phantom": injection.Phantom("acoustic", 100, 8.0), "jam": injection.Jam(100, 3.0), "maneuver": injection.Maneuver(90, 41, 6.0, 2)}


def injected(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for name, x in INJECTIONS.items():
        part = injection.inject(_research(spark, sf_dir), x).select(F.lit(name).alias("injection"), "track_id", "seq", "modality", *(F.round(c, 6).alias(c) for c in ("y0", "p2", "nis")))
        out = part if out is None else out.unionByName(part)
    return out


def _mods3(i: str) -> str:
    return f"(['visual', 'acoustic', 'radar'])[{i} % 3 + 1]"


_OUT = f"""o0 AS (SELECT l_orderkey AS fusion_seq, CASE WHEN l_orderkey % 3 = 0 THEN l_suppkey % 2 ELSE 0 END AS track_id, {_mods3("l_linenumber")} AS modality, l_linenumber, l_partkey, l_quantity AS projection, CASE l_returnflag WHEN 'A' THEN 'updated' WHEN 'N' THEN 'gate_rejected' ELSE 'update_rejected' END AS outcome,
  l_returnflag = 'A' AS v1, 2 + (l_partkey % 31 = 0)::INT AS in_gate, l_orderkey * 100 AS fts, l_linenumber - 1 AS mi, l_discount * 100 AS d2 FROM lineitem),
o AS (SELECT *, row_number() OVER (PARTITION BY fusion_seq, track_id, modality ORDER BY l_linenumber) - 1 AS rn, row_number() OVER (PARTITION BY fusion_seq, track_id, modality ORDER BY l_linenumber) - 1 + (l_partkey % 29 = 0)::INT AS attempt FROM o0)"""
_EXP = _OUT + ", ex AS (SELECT * FROM o), ob AS (SELECT fusion_seq, track_id, modality, mi, fts + (l_partkey % 37 = 0)::INT AS ts, projection + (l_partkey % 41 = 0)::INT AS pr FROM ex WHERE (v1 AND l_partkey % 23 <> 0) OR (outcome = 'gate_rejected' AND l_partkey % 43 = 0))"


def _v(i: int) -> str:
    return f"CAST(embedding[{i + 1}] AS DOUBLE)"


_TRI = "CASE WHEN seq - 90 - code * 2 >= 0 AND seq - 90 - code * 2 < 41 THEN 6.0 * (1 - (41.0 - 2 * least(seq - 90 - code * 2, 41 - (seq - 90 - code * 2))) / 41.0) ELSE 0 END"
#: The inverse of the queries' covariance, as cofactors over the determinant.
_DET = 1.0 * (1.5 * 2.0 - 0.04) - 0.1 * (0.1 * 2.0)
_INV = ((1.5 * 2 - 0.04) / _DET, -(0.1 * 2.0) / _DET, (0.1 * 0.2) / _DET, 2.0 / _DET, -0.2 / _DET, (1.5 - 0.01) / _DET)

QUERIES = {
    "admitted_events": admitted_events, "admitted_covariances": admitted_covariances, "admitted_projections": admitted_projections, "session_names": session_names, "heartbeats": heartbeats, "outcome_rules": outcome_rules, "ledger_faults": ledger_faults,
    "joined_observations": joined_observations, "unprojected_channels": unprojected_channels, "registry_binding": registry_binding, "authority_changes": authority_changes, "injected": injected,
}

ORACLES = {
    "admitted_events": "SELECT CASE WHEN event_id % 97 = 1 THEN 'track_id_out_of_range' WHEN event_id % 101 = 2 THEN 'timestamp_out_of_range' WHEN event_id % 103 = 3 THEN 'sequence_out_of_range' WHEN event_id % 107 = 4 THEN 'unknown_modality' WHEN event_id % 109 = 5 OR event_id % 113 = 6 THEN 'nis_not_finite' WHEN event_id % 127 = 7 THEN 'nis_negative' WHEN event_id % 131 = 8 THEN 'dof_out_of_range' ELSE 'admitted' END AS reason, count(*) AS n_rows FROM events GROUP BY ALL",
    "admitted_covariances": f"""WITH m AS (SELECT vec_id, {_v(0)} + 0.1 AS a, {_v(1)} AS b1, {_v(1)} + CASE WHEN vec_id % 7 = 0 THEN 1e-3 ELSE 0 END AS b2, {_v(2)} AS c, {_v(3)} + 0.2 AS d, {_v(4)} AS e, {_v(5)} + 0.2 AS f FROM embeddings), s AS (SELECT *, (b1 + b2) / 2 AS b FROM m)
SELECT vec_id, CASE WHEN a <= 0 OR d <= 0 OR f <= 0 THEN 'covariance_diagonal' WHEN abs(b1 - b2) > 1e-9 * sqrt(a * d) THEN 'covariance_not_symmetric' WHEN NOT (a * d - b * b > 0 AND a * (d * f - e * e) - b * (b * f - c * e) + c * (b * e - c * d) > 0) THEN 'covariance_not_positive_definite' ELSE 'admitted' END AS reason, CASE WHEN reason = 'admitted' THEN round(b, 6) END AS c01 FROM s""",
    "admitted_projections": "SELECT CASE WHEN vec_id % 5 NOT BETWEEN 1 AND 3 THEN 'projection_dimensions' WHEN vec_id % 11 = 0 AND vec_id % 5 < 3 AND embedding[3] <> 0 THEN 'projection_inactive_axis' WHEN vec_id % 13 = 0 THEN 'projection_identity' ELSE 'admitted' END AS reason, count(*) AS n_rows FROM embeddings GROUP BY ALL",
    "session_names": "WITH n AS (SELECT source AS name FROM documents UNION ALL SELECT url FROM pages UNION ALL SELECT regexp_replace(url, '^https?://|[/?#].*$', '', 'g') FROM pages) SELECT coalesce(length(name) <= 64 AND regexp_full_match(name, '[A-Za-z0-9]([A-Za-z0-9._:-]*[A-Za-z0-9])?'), false) AS valid, count(*) AS n_names, count(DISTINCT name) AS n_different FROM n GROUP BY ALL",
    "heartbeats": "SELECT CASE WHEN event_id % 41 = 0 THEN 'interval_out_of_range' WHEN 400 - event_id % 13 < event_id % 41 * 10 THEN 'deadline_before_interval' WHEN user_id > 65536 THEN 'track_count_out_of_range' WHEN event_id % 53 = 0 THEN 'queue_capacity_out_of_range' WHEN event_id % 59 - 10 > event_id % 53 THEN 'queue_depth_over_capacity' WHEN event_id % 3 = 0 AND event_id % 2 <> 0 THEN 'dropped_but_not_degraded' ELSE 'sound' END AS reason, count(*) AS n_rows FROM events GROUP BY ALL",
    "outcome_rules": f"WITH {_OUT}, g AS (SELECT *, CASE WHEN l_partkey % 9 = 0 THEN 0 ELSE in_gate END AS ig FROM o) SELECT outcome, CASE WHEN outcome <> 'gate_rejected' AND ig = 0 THEN 'candidates_missing' WHEN outcome <> 'gate_rejected' AND NOT d2 < 5.5 THEN 'gate_not_accepted' WHEN outcome = 'updated' AND l_partkey % 10 = 0 THEN 'updated_without_projection' WHEN outcome = 'gate_rejected' AND d2 < 5.5 THEN 'gate_rejected_inside_gate' ELSE 'sound' END AS reason, count(*) AS n_rows FROM g GROUP BY ALL",
    "ledger_faults": f"""WITH {_OUT}, pr AS (SELECT fusion_seq, track_id, modality, count(*) AS n, count(*) FILTER (v1) AS v1n, count(*) FILTER (outcome <> 'gate_rejected') AS tn, bool_or(attempt <> rn2) AS gap, min(in_gate) <> max(in_gate) AS differ FROM (SELECT *, row_number() OVER (PARTITION BY fusion_seq, track_id, modality ORDER BY attempt) - 1 AS rn2 FROM o) GROUP BY ALL),
f AS (SELECT fusion_seq, sum(n)::BIGINT AS received, sum(v1n)::BIGINT AS v1r, count(*) AS np, count(DISTINCT track_id) AS nt, list(DISTINCT modality) AS mods, bool_or(gap) AS gap, bool_or(differ) AS differ, max(v1n) AS vm, max(tn) AS tm FROM pr GROUP BY ALL),
j AS (SELECT o_orderkey AS fusion_seq, o_custkey, coalesce(received, 0) AS received, coalesce(v1r, 0) AS v1_received, coalesce(nt, 0) AS n_tracks, coalesce(np, 0) AS np, coalesce(mods, []) AS mods, coalesce(gap, false) AS gap, coalesce(differ, false) AS differ, coalesce(vm, 0) AS vm, coalesce(tm, 0) AS tm FROM orders LEFT JOIN f ON fusion_seq = o_orderkey),
back AS (SELECT DISTINCT fusion_seq FROM (SELECT fusion_seq, mi <= lag(mi) OVER (PARTITION BY fusion_seq, track_id, modality ORDER BY attempt) AS b FROM o) WHERE b)
SELECT fusion_seq, received, v1_received, n_tracks, CASE WHEN fusion_seq % 17 = 0 THEN 'outcome_count_mismatch' WHEN o_custkey % 23 = 0 AND list_contains(mods, 'acoustic') THEN 'unexpected_modality' WHEN gap THEN 'attempt_gap' WHEN fusion_seq IN (SELECT fusion_seq FROM back) THEN 'measurement_regressed' WHEN differ THEN 'gate_counts_differ' WHEN vm > 1 THEN 'repeated_expectation' WHEN tm > 1 THEN 'repeated_terminal'
  WHEN 1 + (o_custkey % 5 = 0)::INT > n_tracks THEN 'too_few_tracks' WHEN np < n_tracks * CASE WHEN o_custkey % 23 = 0 THEN 2 ELSE 3 END THEN 'missing_pair' WHEN o_custkey % 19 = 0 THEN 'v1_count_mismatch' ELSE 'sound' END AS fault FROM j""",
    "joined_observations": f"WITH {_EXP} SELECT coalesce(e.fusion_seq, b.fusion_seq) AS fusion_seq, coalesce(e.track_id, b.track_id) AS track_id, coalesce(e.modality, b.modality) AS modality, coalesce(e.mi, b.mi) AS measurement_index, CASE WHEN e.fusion_seq IS NULL THEN 'unexpected' WHEN b.fusion_seq IS NULL THEN 'missing' WHEN ts <> fts THEN 'timestamp_mismatch' WHEN pr IS DISTINCT FROM projection THEN 'projection_mismatch' ELSE 'matched' END AS status FROM (SELECT * FROM ex WHERE v1) e FULL JOIN ob b ON e.fusion_seq = b.fusion_seq AND e.track_id = b.track_id AND e.modality = b.modality AND e.mi = b.mi",
    "unprojected_channels": "SELECT s_suppkey AS track_id, m.modality FROM supplier, (VALUES (0, 'visual'), (1, 'thermal'), (2, 'acoustic')) m(i, modality) WHERE s_nationkey < 12 AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_quantity > 48 AND l_tax > 0.02 AND l_suppkey = s_suppkey AND l_linenumber % 3 = m.i)",
    "registry_binding": f"""WITH {views.scenario_sql()}, r AS (SELECT track_id, seq, modality, timestamp_ms, CASE WHEN seq % 7 = 0 OR seq % 5 = 3 THEN 2 ELSE 1 END AS frame_id, seq % 5 AS context_id FROM obs),
c(context_id, f, lo, hi, flo, fhi, mods) AS (VALUES (1, 1, 0, 12000, 0, NULL, ['visual', 'acoustic', 'radar']), (2, 1, 5000, NULL, 0, NULL, ['visual', 'radar']), (3, 2, 8000, 40000, 10000, 30000, ['visual', 'acoustic']))
SELECT track_id, seq, modality, timestamp_ms, frame_id, r.context_id, CASE WHEN c.context_id IS NULL THEN 'unknown_context' WHEN f <> frame_id THEN 'context_frame_mismatch' WHEN NOT timestamp_ms BETWEEN flo AND coalesce(fhi, 9e15) THEN 'frame_not_applicable' WHEN NOT timestamp_ms BETWEEN lo AND coalesce(hi, 9e15) THEN 'context_not_applicable' WHEN NOT list_contains(mods, modality) THEN 'unexpected_modality' ELSE 'bound' END AS binding FROM r LEFT JOIN c USING (context_id)""",
    "authority_changes": """WITH s AS (SELECT o_orderkey AS k, o_custkey, o_orderstatus = 'F' AS deny, lag(o_orderkey) OVER w AS b, lag(o_orderstatus = 'F') OVER w AS bdeny FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey))
SELECT k AS o_orderkey, CASE WHEN o_custkey % 4 = 0 THEN CASE WHEN deny <> bdeny OR k % 3 <> b % 3 OR k % 2 <> b % 2 OR k % 4 <> b % 4 OR (k % 11 = 0) <> (b % 11 = 0) OR (k % 13 = 0) <> (b % 13 = 0) THEN 'record_only_changed' ELSE 'allowed' END
  WHEN (k % 13 = 0) <> (b % 13 = 0) THEN 'capability_changed' WHEN (k % 11 = 0) <> (b % 11 = 0) THEN 'watchdog_changed' WHEN bdeny AND NOT deny THEN 'deny_became_allow' WHEN k % 3 > b % 3 THEN 'velocity_limit_units_increased' WHEN k % 2 > b % 2 THEN 'slew_limit_units_increased' WHEN k % 4 > b % 4 THEN 'lease_expiry_ms_increased' ELSE 'allowed' END AS violation FROM s WHERE b IS NOT NULL""",
    "injected": f"""WITH {views.scenario_sql()}, j AS (SELECT 'phantom' AS injection, track_id, seq, modality, p0 + CASE WHEN modality = 'acoustic' AND seq >= 100 THEN 8.0 ELSE 0 END AS y0, p1 AS y1, p2 AS y2 FROM obs UNION ALL SELECT 'jam', track_id, seq, modality, p0 * k, p1 * k, p2 * k FROM (SELECT *, CASE WHEN seq >= 100 THEN 3.0 ELSE 1.0 END AS k FROM obs) UNION ALL SELECT 'maneuver', track_id, seq, modality, p0 + {_TRI}, p1, p2 FROM obs)
SELECT injection, track_id, seq, modality, round(y0, 6) AS y0, round(y2, 6) AS p2, round({_INV[0]!r} * y0 * y0 + {_INV[3]!r} * y1 * y1 + {_INV[5]!r} * y2 * y2 + 2 * ({_INV[1]!r} * y0 * y1 + {_INV[2]!r} * y0 * y2 + {_INV[4]!r} * y1 * y2), 6) AS nis FROM j""",
}
