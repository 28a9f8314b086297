"""Frame alignment and signed-correlation consensus over the newest contiguous suffix.

Pairwise correlations are over the last ``window`` aligned frames. A column
that is constant in the window is an analysis error, never a weak edge.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from accordant.config import CorrelationConfig, DetectorConfig
from accordant.schema import canonical

EPSILON = 2.220446049250313e-16
#: A variance of unitless values that isn't told from none.
LEAST = 1e-300


def aligned(wide: DataFrame, cfg: DetectorConfig, modalities: tuple[str, ...]) -> DataFrame:
    """Add ``complete``, ``projected``, ``partial``, ``coherent``, ``suffix`` and ``place`` (from 1 in the suffix; null where the frame isn't in one).

    Frames (of ``frames`` with timestamp_ms, p0, frame_id, context_id and
    prior_id of each channel) break the suffix when a channel or all
    projections are missing, clocks disagree, sequence or time jump, or the
    provenance changes. Incomplete, unprojected and incoherent frames are
    dropped; after the other breaks a frame begins the new suffix. A frame
    with only some projections, or with different provenance among channels,
    is an error.
    """
    mods = canonical(modalities)
    col = lambda m, c: F.col(f"{m}_{c}")
    every = lambda xs: _all(list(xs))
    present = every(col(m, "timestamp_ms").isNotNull() for m in mods)
    with_projection = sum((col(m, "p0").isNotNull().cast("int") for m in mods), F.lit(0))
    stamps = [col(m, "timestamp_ms") for m in mods]
    first = mods[0]
    agree = every((col(m, c) == col(first, c)) for m in mods[1:] for c in ("frame_id", "context_id", "prior_id")) if len(mods) > 1 else F.lit(True)
    flags = wide.withColumns(
        {
            "complete": present,
            "projected": present & (with_projection == len(mods)),
            "partial": present & (with_projection > 0) & ((with_projection < len(mods)) | ~F.coalesce(agree, F.lit(False))),
            "coherent": F.coalesce(F.greatest(*stamps) - F.least(*stamps) <= cfg.max_timestamp_skew_ms, F.lit(False)) if len(mods) > 1 else present,
        }
    )
    track = Window.partitionBy("track_id", "generation").orderBy("seq")
    usable = F.col("projected") & F.col("coherent") & ~F.col("partial")
    flags = flags.withColumn("_usable", usable)
    changed = _any([(col(first, c) != F.lag(col(first, c)).over(track)) for c in ("frame_id", "context_id")])
    late = _any([(col(m, "timestamp_ms") - F.lag(col(m, "timestamp_ms")).over(track) > cfg.max_inter_sample_gap_ms) for m in mods])
    follows = F.lag("_usable").over(track) & (F.col("seq") - F.lag("seq").over(track) <= cfg.max_seq_gap) & ~F.coalesce(changed, F.lit(False)) & ~F.coalesce(late, F.lit(False))
    begun = flags.withColumn("_begins", F.col("_usable") & ~F.coalesce(follows, F.lit(False)))
    numbered = begun.withColumn("suffix", F.sum(F.col("_begins").cast("int")).over(track.rowsBetween(Window.unboundedPreceding, 0)).cast("long"))
    inside = Window.partitionBy("track_id", "generation", "suffix").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    # Unusable frames after a suffix carry its number; they come after all its usable frames.
    return numbered.withColumn("place", F.when(F.col("_usable"), F.sum(F.col("_usable").cast("int")).over(inside))).drop("_usable", "_begins")


def with_reuse(checked: DataFrame) -> DataFrame:
    """Add ``reused`` to ``ordering.checked`` rows: whether, up to the row's frame, two frames of the track have had one prior.

    A prior belongs to one frame. Rows of modalities that weren't asked for
    count too, other refused ones don't; a track stays marked.
    """
    counts = F.col("reject").isNull() | (F.col("reject") == "unexpected_modality")
    of_prior = Window.partitionBy("track_id", "prior_id")
    first = F.min(F.when(counts & F.col("p0").isNotNull(), F.col("seq"))).over(of_prior)
    again = counts & F.col("p0").isNotNull() & F.col("prior_id").isNotNull() & (F.col("seq") > first)
    until = Window.partitionBy("track_id").orderBy("seq").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return checked.withColumn("reused", F.coalesce(F.max(again).over(until), F.lit(False)))


def prior_reuse(rows: DataFrame) -> DataFrame:
    """One row a (track_id, prior_id) that more than one sequence has: n_frames, first_seq and last_seq.

    A prior belongs to one frame; whichever channels are asked for, all rows count.
    """
    seen = rows.filter(F.col("prior_id").isNotNull()).groupBy("track_id", "prior_id")
    told = seen.agg(F.countDistinct("seq").alias("n_frames"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))
    return told.filter("n_frames > 1")


#: Frames of a track that are retained.
MAX_RETAINED_FRAMES = 65_536


#: Sequences that are counted together when the cut is looked for.
BUCKET = 4_096


def retained(rows: DataFrame, frames: int = MAX_RETAINED_FRAMES, bucket: int = BUCKET) -> DataFrame:
    """The rows of each track's newest ``frames`` sequences; rows without a track or a sequence are none of them.

    Two passes find each track's cut, and no track is sorted whole: distinct
    sequences are counted by bucket, and only those of the bucket in which the
    count is reached are ranked. Then rows are compared with the cut.
    """
    known = rows.filter("seq IS NOT NULL AND track_id IS NOT NULL")
    part = F.floor(F.col("seq") / bucket)
    seen = known.select("track_id", "seq").distinct().withColumn("_part", part)
    counts = seen.groupBy("track_id", "_part").agg(F.count("*").alias("_n"))
    newer = Window.partitionBy("track_id").orderBy(F.desc("_part")).rowsBetween(Window.unboundedPreceding, -1)
    above = counts.withColumn("_above", F.coalesce(F.sum("_n").over(newer), F.lit(0)))
    edge = above.filter((F.col("_above") < frames) & (F.col("_above") + F.col("_n") >= frames)).drop("_n")
    inside = seen.join(edge, ["track_id", "_part"])
    rank = F.row_number().over(Window.partitionBy("track_id", "_part").orderBy(F.desc("seq")))
    cut = inside.withColumn("_nth", rank + F.col("_above")).filter(F.col("_nth") == frames).select(F.col("track_id").alias("_of"), F.col("seq").alias("_cut"))
    told = known.join(cut, F.col("track_id") == F.col("_of"), "left")
    return told.filter(F.col("_cut").isNull() | (F.col("seq") >= F.col("_cut"))).drop("_of", "_cut")


def _all(xs: list[Column]) -> Column:
    out = xs[0]
    for x in xs[1:]:
        out = out & x
    return out


def _any(xs: list[Column]) -> Column:
    out = xs[0]
    for x in xs[1:]:
        out = out | x
    return out


def unitless(frames: DataFrame, columns: list[str], keys: tuple[str, ...]) -> DataFrame:
    """Replace columns by their distance from the group's value of least size, in units of the largest such distance.

    A correlation has no unit, so this changes none; but sums of squares then
    neither overflow nor vanish, and a large offset takes no digits away. A
    single huge value sets the unit and nothing else. Groups without a finite
    value become null.
    """
    whole = Window.partitionBy(*keys)
    finite = lambda c: F.when(F.abs(c) < float("inf"), F.col(c))
    centred = frames.withColumns({f"_c_{c}": F.min_by(finite(c), F.abs(finite(c))).over(whole) for c in columns})
    # Halved, as the distance of two doubles may be no double.
    moved = centred.withColumns({c: F.col(c) / 2 - F.col(f"_c_{c}") / 2 for c in columns}).drop(*(f"_c_{c}" for c in columns))
    sized = moved.withColumns({f"_m_{c}": F.max(F.abs(finite(c))).over(whole) for c in columns})
    return sized.withColumns({c: F.try_divide(F.col(c), F.col(f"_m_{c}")) for c in columns}).drop(*(f"_m_{c}" for c in columns))


def pair_correlations(frames: DataFrame, cfg: CorrelationConfig, modalities: tuple[str, ...], axes: int = 3) -> DataFrame:
    """Add ``w`` (aligned samples in the window) and r_<axis>_<i>_<j> for channels i < j; null where degenerate or not aligned.

    Each window is summed from its own rows, about their means: nothing of
    older rows is left in it. Values are made ``unitless`` in their suffix
    first, so neither scale nor offset matters. Constant and non-finite columns
    are null, and so are values under 1e-150 of the suffix's largest.
    """
    mods = canonical(modalities)
    keys = ("track_id", "generation", "suffix")
    own = Window.partitionBy(*keys).orderBy("seq").rowsBetween(-(cfg.window - 1), 0)
    in_suffix = F.col("place").isNotNull()
    columns = [(a, i) for a in range(axes) for i in range(len(mods))]
    pairs = [(a, i, j) for a in range(axes) for i, j in combinations(range(len(mods)), 2)]
    plain = {f"_p_{a}_{i}": F.when(in_suffix, F.col(f"{mods[i]}_p{a}")) for a, i in columns}
    scaled = unitless(frames.withColumns(plain), list(plain), keys)
    spread = {f"_v_{a}_{i}": F.var_pop(f"_p_{a}_{i}").over(own) for a, i in columns}
    both = {f"_r_{a}_{i}_{j}": F.covar_pop(f"_p_{a}_{i}", f"_p_{a}_{j}").over(own) for a, i, j in pairs}
    windowed = scaled.withColumns(spread | both)
    out = {"w": F.when(in_suffix, F.least(F.col("place"), F.lit(cfg.window)))}
    for a, i, j in pairs:
        r = f"_r_{a}_{i}_{j} / (sqrt(_v_{a}_{i}) * sqrt(_v_{a}_{j}))"
        sound = f"place IS NOT NULL AND _v_{a}_{i} > {LEAST!r}D AND _v_{a}_{j} > {LEAST!r}D AND NOT isnan(_r_{a}_{i}_{j})"
        out[f"r_{a}_{i}_{j}"] = F.expr(f"CASE WHEN {sound} THEN greatest(-1D, least(1D, {r})) END")
    return windowed.withColumns(out).drop(*plain, *spread, *both)


def consensus(frames: DataFrame, cfg: CorrelationConfig, modalities: tuple[str, ...], axes: int = 3) -> DataFrame:
    """Add corr_<axis> (nominal, decoupled, insufficient, error) and mask_<axis>, the decoupled channels as bits.

    Attribution needs a unique clique of a strict majority, all of whose pairs
    reach the threshold (the largest of the floor, Fisher's floor and a share
    of the strongest pair), and no channel outside it that reaches the
    threshold with any of its members.
    """
    c = len(canonical(modalities))
    pairs = list(combinations(range(c), 2))
    number = lambda x: f"{x!r}D"
    any_of = lambda xs: " OR ".join(f"({x})" for x in xs)
    floors = ", ".join(map(number, cfg.floors(c)))
    # Parsed expressions in one projection that refer to each other: many small Column calls, or many projections, would
    # take longer to plan than to run.
    steps = {"_floor": f"array({floors})[CAST(coalesce(w, 0) AS INT)]"}
    for a in range(axes):
        if c < 3:
            steps |= {f"corr_{a}": "'insufficient'", f"mask_{a}": "0"}
            continue
        of = lambda name, axis=a: f"_{name}_{axis}"
        r = {p: f"r_{a}_{p[0]}_{p[1]}" for p in pairs}
        edge = {p: of(f"e_{p[0]}_{p[1]}") for p in pairs}
        reference, threshold, largest, ties, clique = map(of, ("reference", "threshold", "largest", "ties", "clique"))
        members = {mask: [i for i in range(c) if mask >> i & 1] for mask in range(1, 1 << c)}
        cliques = {mask: " AND ".join(edge[p] for p in combinations(own, 2)) or "true" for mask, own in members.items()}
        best = {mask: f"{holds} AND {largest} = {mask.bit_count()}" for mask, holds in cliques.items()}
        bridged = any_of(f"{edge[i, j]} AND ({clique} & {1 << i} <> 0) <> ({clique} & {1 << j} <> 0)" for i, j in pairs)
        below = (f"{reference} < {number(cfg.corr_floor)}", "_floor >= 1.0D", f"{reference} < {threshold}")
        unclear = any_of((*below, f"NOT (2 * {largest} > {c} AND {ties} = 1)", bridged))
        missing = any_of(f"{x} IS NULL" for x in r.values())
        everyone = (1 << c) - 1
        steps |= {
            reference: f"greatest({', '.join(r.values())})",
            threshold: f"greatest({number(cfg.corr_floor)}, _floor, {number(cfg.decouple_ratio)} * {reference})",
            **{edge[p]: f"{r[p]} >= {threshold}" for p in pairs},
            largest: f"greatest({', '.join(f'IF({holds}, {mask.bit_count()}, 0)' for mask, holds in cliques.items())})",
            ties: " + ".join(f"IF({b}, 1, 0)" for b in best.values()),
            clique: f"greatest({', '.join(f'IF({b}, {mask}, 0)' for mask, b in best.items())})",
            f"corr_{a}": f"CASE WHEN coalesce(w, 0) < {cfg.min_samples} THEN 'insufficient' WHEN {missing} THEN 'error'"
            f" WHEN {unclear} THEN 'insufficient' WHEN {clique} = {everyone} THEN 'nominal' ELSE 'decoupled' END",
            f"mask_{a}": f"IF(corr_{a} = 'decoupled', {everyone} - {clique}, 0)",
        }
    out = frames.selectExpr("*", *(f"{text} AS `{name}`" for name, text in steps.items()))
    return out.drop(*(name for name in steps if name.startswith("_")))
