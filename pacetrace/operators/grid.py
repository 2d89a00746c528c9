"""Alignment of laps on a one-metre distance grid and time differences between laps.

Frames are first reduced to the first and last sample of every metre (a partial aggregation), so the steps
that need a whole lap in order see at most one row per metre of track, however many samples the lap has.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordered import CHUNK_ROWS, chunk_of, kth_value, scan
from ..functions.ranges import range_join
from .segments import LAP

BOXCAR_RADIUS = 20
MAX_NEUTRAL_RUN = 5


def strip_stale(frames: DataFrame, lap_length: Column) -> DataFrame:
    """Drop boundary samples that still carry the previous lap's distance at a negative lap clock."""
    stale = (F.col("lap_time_s") < 0) & (F.col("lap_distance_m") > lap_length * 0.5)
    return frames.filter(~F.coalesce(stale, F.lit(False)))


def strip_boundary(frames: DataFrame, track_len: Column) -> DataFrame:
    """Wider form: a sample past half the lap in its first half second.  Rows with a missing value stay."""
    t, d = F.col("lap_time_s"), F.col("lap_distance_m")
    stale = ~F.isnan(t) & ~F.isnan(d) & (t < 0.5) & (d > track_len * 0.5)
    return frames.filter(~F.coalesce(stale, F.lit(False)))


def _run_context(frames: DataFrame, keys: Sequence[str], order: str, value: str, chunk_rows: int) -> DataFrame:
    """Add ``run`` and ``nxt``: (pos, v, before) of the start of the row's run of equal values and of the next
    run; ``pos`` is the row's ordinal in its key.

    One pass: each chunk treats its first row as a possible start, and the chunk table settles whether it is
    one and hands the open run and the next start across chunk borders.
    """
    v = F.col(value)
    w = Window.partitionBy(*keys, "__c").orderBy(order)
    back = Window.partitionBy(*keys, "__c").orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, -1)
    inner_start = (F.col("__rn") > 1) & ~F.col("__p.v").eqNullSafe(v)
    mark = F.when(inner_start, F.struct(F.col("__rn").alias("pos"), v.alias("v"), F.col("__p.v").alias("before")))

    def marked(df: DataFrame) -> DataFrame:
        return (
            df.withColumn("__c", chunk_of(order, chunk_rows))
            .withColumn("__rn", F.row_number().over(w).cast("long"))
            .withColumn("__p", F.lag(F.struct(v.alias("v"))).over(w))
            .withColumn("__mark", mark)
        )

    chunks = marked(frames.select(*keys, order, value)).groupBy(*keys, "__c").agg(
        F.count(F.lit(1)).alias("n"),
        F.min_by(F.struct(v.alias("v")), order).alias("first_v"),
        F.max_by(F.struct(v.alias("v")), order).alias("last_v"),
        F.min("__mark").alias("first_mark"),
        F.max("__mark").alias("last_mark"),
    )
    wc = Window.partitionBy(*keys).orderBy("__c")
    before = wc.rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(*keys).orderBy(F.desc("__c")).rowsBetween(Window.unboundedPreceding, -1)

    def shifted(m: Column) -> Column:
        return F.when(
            m.isNotNull(), F.struct((m["pos"] + F.col("__off")).alias("pos"), m["v"].alias("v"), m["before"].alias("before"))
        )

    real = F.col("prev_v").isNull() | ~F.col("prev_v.v").eqNullSafe(F.col("first_v.v"))
    own = F.struct((F.col("__off") + 1).alias("pos"), F.col("first_v.v").alias("v"), F.col("prev_v.v").alias("before"))
    chunks = (
        chunks.withColumn("__off", F.coalesce(F.sum("n").over(before), F.lit(0)))
        .withColumn("prev_v", F.lag("last_v").over(wc))
        .withColumn("own", F.when(real, own))
        .withColumn("lead_mark", F.coalesce("own", shifted(F.col("first_mark"))))
        .withColumn("tail_mark", F.coalesce(shifted(F.col("last_mark")), F.col("own")))
        .select(
            *keys, "__c", "__off",
            F.coalesce("own", F.last("tail_mark", True).over(before)).alias("__open"),
            F.last("lead_mark", True).over(after).alias("__coming"),
        )
    )
    f = (
        marked(frames)
        .withColumn("__run", F.last("__mark", True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("__nxt", F.last("__mark", True).over(back))
        .join(chunks, [*keys, "__c"])
    )
    return f.select(
        *frames.columns,
        (F.col("__off") + F.col("__rn")).alias("pos"),
        F.coalesce(shifted(F.col("__run")), F.col("__open")).alias("run"),
        F.coalesce(shifted(F.col("__nxt")), F.col("__coming")).alias("nxt"),
    )


def smooth_clock(
    frames: DataFrame,
    keys: Sequence[str] = tuple(LAP),
    order: str = "frame_id",
    value: str = "lap_time_s",
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Bridge plateaus of equal consecutive clock values linearly, by row count; the last one stays flat."""
    f = _run_context(frames, keys, order, value, chunk_rows)
    share = (F.col("pos") - F.col("run.pos")) / (F.col("nxt.pos") - F.col("run.pos"))
    rise = F.coalesce((F.col("nxt.v") - F.col("run.v")) * share, F.lit(0.0))
    return f.withColumn(value, F.col(value) + rise).select(*frames.columns)


def bridge_neutral(
    frames: DataFrame,
    keys: Sequence[str] = tuple(LAP),
    order: str = "frame_id",
    gear: str = "gear",
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Runs of neutral up to five samples between two gears take the gear before them."""
    f = _run_context(frames, keys, order, gear, chunk_rows)
    short = (
        (F.col(gear) == 0)
        & (F.col("nxt.pos") - F.col("run.pos") <= MAX_NEUTRAL_RUN)
        & F.col("run.before").isNotNull()
    )
    return f.withColumn(gear, F.when(short, F.col("run.before")).otherwise(F.col(gear))).select(*frames.columns)


def metre_buckets(
    frames: DataFrame,
    keys: Sequence[str],
    channels: Sequence[str],
    distance: str = "lap_distance_m",
    order: str = "frame_id",
    extra: Sequence[Column] = (),
) -> DataFrame:
    """First and last sample of every metre: keys, ``b``, ``head``, ``tail`` (x, o, channels)."""
    x = F.col(distance).cast("double")
    sample = F.struct(x.alias("x"), F.col(order).alias("o"), *[F.col(c).cast("double").alias(c) for c in channels])
    return (
        frames.filter(x.isNotNull() & ~F.isnan(x))
        .groupBy(*keys, F.ceil(x).cast("long").alias("b"))
        .agg(F.min(sample).alias("head"), F.max(sample).alias("tail"), *extra)
    )


def resample(
    frames: DataFrame,
    keys: Sequence[str],
    channels: Sequence[str],
    *,
    limit: str | None = None,
    distance: str = "lap_distance_m",
    order: str = "frame_id",
    clamp: bool = True,
    include_last: bool = True,
) -> DataFrame:
    """Linear values at every metre 0…max, clamped outside the sampled range.

    At a repeated distance the last sample counts, except at or before the first distance, where the first
    does.  ``limit`` names a column of ``frames`` (constant in a key) with the last metre wanted; by default
    it is the key's own furthest distance.  ``clamp=False`` leaves the outside cells out.
    """
    extra = [F.max(limit).cast("long").alias("__limit")] if limit else []
    buckets = metre_buckets(frames, keys, channels, distance, order, extra)
    w = Window.partitionBy(*keys).orderBy("b")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    last_cell = F.max("__limit" if limit else "b").over(whole) - (0 if include_last else 1)
    # One order for all three: one window step.
    b = buckets.select("*", F.lead("head").over(w).alias("nxt"), F.lag("b").over(w).isNull().alias("is_first"), last_cell.alias("hi"))
    lo = F.when(F.col("is_first") & F.lit(clamp), F.lit(0)).otherwise(F.greatest(F.col("b"), F.lit(0)))
    end = F.col("hi") if clamp else F.least(F.col("hi"), F.floor(F.col("tail.x")))
    hi = F.when(F.col("nxt").isNull(), end).otherwise(F.least(F.ceil(F.col("nxt.x")) - 1, F.col("hi")))
    cells = (
        b.withColumn("lo", lo.cast("long"))
        .withColumn("hi", hi.cast("long"))
        .filter(F.col("lo") <= F.col("hi"))
        .withColumn("s_m", F.explode(F.sequence("lo", "hi")))
    )
    share = (F.col("s_m") - F.col("tail.x")) / (F.col("nxt.x") - F.col("tail.x"))

    def value(c: str) -> Column:
        at = (
            F.when(F.col("is_first") & (F.col("s_m") <= F.col("head.x")), F.col(f"head.{c}"))
            .when(F.col("nxt").isNull(), F.col(f"tail.{c}"))
            .otherwise(F.col(f"tail.{c}") + share * (F.col(f"nxt.{c}") - F.col(f"tail.{c}")))
        )
        return at.alias(c)

    return cells.select(*keys, F.col("s_m").cast("int").alias("s_m"), *[value(c) for c in channels])


def resample_gear(frames: DataFrame, keys: Sequence[str] = tuple(LAP)) -> DataFrame:
    """Gear per metre after neutral bridging; halves round up."""
    return resample(bridge_neutral(frames, keys), keys, ["gear"]).withColumn(
        "gear", F.floor(F.col("gear") + 0.5).cast("int")
    )


def forward_clamp(grid: DataFrame, column: str = "lap_time_s", keys: Sequence[str] = tuple(LAP)) -> DataFrame:
    """Running maximum along the lap: the clock never falls with distance."""
    w = Window.partitionBy(*keys).orderBy("s_m").rowsBetween(Window.unboundedPreceding, 0)
    return grid.withColumn(column, F.max(column).over(w))


def delta_trace(driver: DataFrame, reference: DataFrame, on: Sequence[str]) -> DataFrame:
    """Time difference in ms per metre over the shorter grid; positive means the driver is slower.

    Reference columns arrive prefixed ``ref_``.
    """
    names = [c for c in reference.columns if c not in (*on, "s_m")]
    ref = reference.select(*on, "s_m", *[F.col(c).alias(f"ref_{c}") for c in names])
    return driver.join(ref, [*on, "s_m"]).withColumn(
        "delta_ms", (F.col("lap_time_s") - F.col("ref_lap_time_s")) * 1000.0
    )


def boxcar(df: DataFrame, column: str, keys: Sequence[str] = tuple(LAP), radius: int = BOXCAR_RADIUS) -> DataFrame:
    """Symmetric mean whose radius shrinks to zero at both ends; non-finite cells are left out.

    Interior cells use a plain moving average.  Only cells within ``2*radius`` of an end enter the list that
    the shrinking edge cells slice.
    """
    w = Window.partitionBy(*keys).orderBy("s_m")
    whole, near = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing), w.rowsBetween(-radius, radius)
    i, n = F.col("s_m"), F.col("__n")
    finite = F.when(~F.isnan(column), F.col(column))
    at_edge = (i < 2 * radius) | (i > n - 1 - 2 * radius)
    r = F.least(F.lit(radius), i, n - 1 - i)
    cells = F.slice(F.col("__near"), (i - r - F.greatest(i - radius, F.lit(0)) + 1).cast("int"), (2 * r + 1).cast("int"))
    kept = F.filter(cells, lambda c: c["v"].isNotNull())
    mean = F.aggregate(kept, F.lit(0.0), lambda a, c: a + c["v"]) / F.size(kept)
    return (
        df.withColumn("__n", F.count(F.lit(1)).over(whole))
        .withColumns({
            "__near": F.collect_list(F.when(at_edge, F.struct(finite.alias("v")))).over(near),
            "__mid": F.avg(finite).over(near),
        })
        .withColumn(
            column,
            F.coalesce(F.when(r == radius, F.col("__mid")).when(F.size(kept) > 0, mean), F.col(column)),
        )
        .drop("__n", "__near", "__mid")
    )


GRID_CHANNELS = ("lap_time_s", "speed_kph", "throttle_norm", "brake_norm")


def lap_grid(frames: DataFrame, channels: Sequence[str] = GRID_CHANNELS, limit: str | None = None) -> DataFrame:
    """Plateau smoothing, resampling and forward clamp of each lap in ``frames``."""
    return forward_clamp(resample(smooth_clock(frames), LAP, channels, limit=limit))


def overlap_window(frames: DataFrame, pairs: DataFrame) -> DataFrame:
    """Metres covered by both laps of each pair (session/segment against ref_session/ref_segment)."""
    ends = frames.groupBy(*LAP).agg(
        F.min("lap_distance_m").alias("lo"), F.ceil(F.max("lap_distance_m")).cast("int").alias("hi")
    )
    ref = ends.select(
        F.col("session_id").alias("ref_session_id"),
        F.col("segment_index").alias("ref_segment_index"),
        F.col("lo").alias("ref_lo"),
        F.col("hi").alias("ref_hi"),
    )
    return (
        pairs.join(ends, LAP)
        .join(ref, ["ref_session_id", "ref_segment_index"])
        .withColumn("overlap_start_m", F.greatest("lo", "ref_lo"))
        .withColumn("overlap_end_m", F.least("hi", "ref_hi"))
    )


def lookup(
    frames: DataFrame,
    targets: DataFrame,
    keys: Sequence[str],
    by: Sequence[str],
    channels: Sequence[str],
) -> DataFrame:
    """Channel values at target distances: linear in the bracket x0 < s <= x1, clamped at the ends.

    ``targets`` holds ``by`` (a subset of ``keys``, e.g. the track) and ``target_s_m``.  Each sample falls in
    exactly one interval between neighbouring targets and is pre-aggregated there.
    """
    w = Window.partitionBy(*by).orderBy("target_s_m")
    t = targets.select(*by, "target_s_m").distinct()
    intervals = t.select(
        *by, F.col("target_s_m").alias("lo"), F.lead("target_s_m").over(w).alias("hi"), F.row_number().over(w).alias("j")
    )
    spine = intervals.select(*by, F.col("j"), F.col("lo").alias("target_s_m"))
    edge = F.struct(F.col("lap_distance_m").cast("double").alias("x"), F.col("frame_id").alias("o"),
                    *[F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")).alias(c) for c in channels])
    # The open-ended outer intervals are handled by comparison with the track's first and last target.
    ends = intervals.groupBy(*by).agg(F.min("lo").alias("t_lo"), F.max("lo").alias("t_hi"), F.max("j").alias("j_hi"))
    inner = range_join(
        frames, intervals.filter(F.col("hi").isNotNull()), list(by), "lap_distance_m", "lo", "hi", include_hi=False
    ).select(*keys, "j", edge.alias("p"))
    outer = frames.join(ends, list(by)).filter(
        (F.col("lap_distance_m") < F.col("t_lo")) | (F.col("lap_distance_m") >= F.col("t_hi"))
    ).select(*keys, F.when(F.col("lap_distance_m") < F.col("t_lo"), 0).otherwise(F.col("j_hi")).alias("j"), edge.alias("p"))
    parts = inner.unionByName(outer).groupBy(*keys, "j").agg(F.min("p").alias("head"), F.max("p").alias("tail"))
    laps = parts.select(*keys).distinct()
    rows = laps.join(
        spine.select(*by, "j", "target_s_m").unionByName(
            spine.select(*by).distinct().select(*by, F.lit(0).alias("j"), F.lit(None).cast("double").alias("target_s_m"))
        ),
        list(by),
    ).join(parts, [*keys, "j"], "left")
    before = Window.partitionBy(*keys).orderBy("j").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(*keys).orderBy(F.desc("j")).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("l", F.last("tail", True).over(before)).withColumn("r", F.last("head", True).over(after))
    rows = rows.filter(F.col("target_s_m").isNotNull())
    share = (F.col("target_s_m") - F.col("l.x")) / (F.col("r.x") - F.col("l.x"))

    def value(c: str) -> Column:
        lv, rv = F.col(f"l.{c}"), F.col(f"r.{c}")
        return (
            F.when(F.col("l").isNull(), rv).when(F.col("r").isNull(), lv)
            .otherwise(F.coalesce(lv + share * (rv - lv), lv)).alias(c)
        )

    return rows.select(*keys, "target_s_m", *[value(c) for c in channels])


def sector_distances(frames: DataFrame, splits: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Distance at which the lap clock reaches each split (``split_1_s``, ``split_2_s``), between two samples."""
    f = scan(frames, LAP, "frame_id", prev={"t0": "lap_time_s", "d0": "lap_distance_m"}, chunk_rows=chunk_rows)
    f = f.join(splits, LAP)
    t, d = F.col("lap_time_s"), F.col("lap_distance_m")
    t0, d0 = F.coalesce("t0", t), F.coalesce("d0", d)

    def crossing(split: str) -> Column:
        share = F.when(t0 == t, F.lit(0.0)).otherwise((F.col(split) - t0) / (t - t0))
        at = d0 + share * (d - d0)
        return F.min_by(at, F.when(t >= F.col(split), F.col("frame_id")))

    return f.groupBy(*LAP).agg(crossing("split_1_s").alias("sector_1_m"), crossing("split_2_s").alias("sector_2_m"))


def distance_step(frames: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Upper median of the positive distance steps of each lap, and whether it is coarser than 2 m."""
    f = scan(frames, LAP, "frame_id", prev={"d0": "lap_distance_m"}, chunk_rows=chunk_rows)
    step = F.col("lap_distance_m") - F.col("d0")
    mid = kth_value(f.filter(step > 0).withColumn("step", step), LAP, "step", F.floor(F.col("n") / 2), "median_step_m")
    return (
        frames.select(*LAP).distinct().join(mid.drop("n"), LAP, "left")
        .withColumn("median_step_m", F.coalesce("median_step_m", F.lit(0.0)))
        .withColumn("coarse", F.col("median_step_m") > 2)
    )


def backward_steps(frames: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Every sample whose distance does not exceed that of the sample before it."""
    f = scan(frames, LAP, "frame_id", prev={"prev_distance_m": "lap_distance_m"}, chunk_rows=chunk_rows)
    return f.filter(F.col("lap_distance_m") <= F.col("prev_distance_m"))


def visible_box(grid: DataFrame, ranges: DataFrame) -> DataFrame:
    """Bounding box of each lap's metres inside the range of its track (``from_m``, ``to_m``, in either order).

    No box when the range covers the whole lap.
    """
    lo, hi = F.least("from_m", "to_m"), F.greatest("from_m", "to_m")
    inside = F.col("s_m").between(F.floor(lo + 0.5), F.floor(hi + 0.5))
    whole = F.max((lo <= 0) & (hi >= F.col("last_m")))

    def bound(fn, c: str, name: str) -> Column:
        return F.when(~whole, fn(F.when(inside & ~F.isnan(c), F.col(c)))).alias(name)

    last = F.max("s_m").over(Window.partitionBy(*LAP))
    return (
        grid.withColumn("last_m", last)
        .join(ranges, [c for c in ranges.columns if c not in ("from_m", "to_m")])
        .groupBy(*LAP)
        .agg(
            bound(F.min, "pos_x_m", "min_x"), bound(F.max, "pos_x_m", "max_x"),
            bound(F.min, "pos_z_m", "min_z"), bound(F.max, "pos_z_m", "max_z"),
        )
    )
