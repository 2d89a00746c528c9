"""Track geometry: width profiles, centre paths, boundaries, outlines, alignment and heat-map tables.

Frames are reduced to distance bins by a partial aggregation first; the ordered steps that follow see one row
per bin of a track.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordered import scan
from ..functions.ranges import range_join
from ..functions.storage import materialise
from .grid import lookup
from .segments import LAP

# Fixed values of the profile.
MIN_SAMPLES = 3
MAX_INTERPOLATE_GAP = 10
SMOOTH_WINDOW = 5
INFER_WINDOW = 10
INFER_MAX_RUN = 10
INFER_MIN_NEIGHBOURS = 2
INFER_CONFIDENCE = 0.35
PROBE_M = 25.0
TANGENT_WINDOW_M = 2.0
HEAT_STEP_M = 2

TRACK = ["track_id"]


def _along():
    """The bins of a track in order."""
    return Window.partitionBy("track_id").orderBy("s_m")


def width_profile(frames: DataFrame, bin_m: float = 1.0) -> DataFrame:
    """Track width left and right of the path per distance bin; bins without samples are listed as missing."""
    d, lat, edge = F.col("raw_lap_distance_m"), F.col("path_lateral_m"), F.col("track_edge_m")
    ok = ~F.isnan(d) & ~F.isnan(lat) & ~F.isnan(edge)
    left, width = lat < 0, F.abs(edge)
    bins = frames.filter(F.coalesce(ok, F.lit(False))).groupBy(*TRACK, F.floor(d / bin_m).cast("long").alias("b")).agg(
        F.max(F.when(left, width)).alias("l"), F.max(F.when(~left, width)).alias("r"),
        F.count_if(left).alias("left_samples"), F.count_if(~left).alias("right_samples"))
    spine = bins.groupBy(*TRACK).agg(F.min("b").alias("lo"), F.max("b").alias("hi")).select(
        *TRACK, F.explode(F.sequence("lo", "hi")).alias("b"))
    zero = F.lit(0).cast("long")
    p = spine.join(bins, [*TRACK, "b"], "left").select(
        *TRACK, (F.col("b") * bin_m).alias("s_m"), F.coalesce("l", F.lit(0.0)).alias("left_width_m"), F.coalesce("r", F.lit(0.0)).alias("right_width_m"),
        F.coalesce("left_samples", zero).alias("left_samples"), F.coalesce("right_samples", zero).alias("right_samples"))
    lo, hi = F.least("left_samples", "right_samples"), F.greatest("left_samples", "right_samples")
    status = F.when(hi == 0, "missing").when(lo == 0, "one-sided").when(lo < MIN_SAMPLES, "low-sample").otherwise("complete")
    confidence = F.when(hi == 0, 0.0).when(lo == 0, 0.5).when(lo < MIN_SAMPLES, 0.75).otherwise(1.0)
    return p.withColumn("status", status).withColumn("confidence", confidence)


def smooth_profile(profile: DataFrame, max_gap: int = MAX_INTERPOLATE_GAP, window: int = SMOOTH_WINDOW) -> DataFrame:
    """Fill short gaps from their neighbours and smooth each side over the bins that have it.

    A longer gap stays at width 0 and gives nothing to its neighbours, but does not end their window.
    """
    upto = _along().rowsBetween(Window.unboundedPreceding, 0)
    back = Window.partitionBy("track_id").orderBy(F.desc("s_m")).rowsBetween(Window.unboundedPreceding, 0)
    known = F.col("status") != "missing"
    side = lambda s: F.when(F.col(f"{s}_samples") > 0, F.col(f"{s}_width_m"))
    p = profile.withColumn("i", F.row_number().over(_along())).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("track_id")))
    mark = F.when(known, F.struct("i", side("left").alias("left"), side("right").alias("right")))
    p = p.withColumn("a", F.last(mark, True).over(upto)).withColumn("z", F.last(mark, True).over(back))
    before, after = F.coalesce("a.i", F.lit(0)), F.coalesce("z.i", F.col("n") + 1)
    short = ~known & (after - before - 1 <= max_gap)
    t = (F.col("i") - before) / (after - before)

    def filled(s: str) -> Column:
        va, vz = F.col(f"a.{s}"), F.col(f"z.{s}")
        return F.when(known, side(s)).when(short, F.coalesce(va + t * (vz - va), va, vz))

    p = p.withColumn("fl", filled("left")).withColumn("fr", filled("right"))
    near = _along().rowsBetween(-window, window)
    barrier = ~known & F.col("fl").isNull() & F.col("fr").isNull()
    smooth = lambda c: F.when(barrier, 0.0).otherwise(F.coalesce(F.avg(c).over(near), F.lit(0.0)))
    return p.withColumn("left_smooth_m", smooth("fl")).withColumn("right_smooth_m", smooth("fr")).drop("i", "n", "a", "z", "fl", "fr")


def infer_one_sided(profile: DataFrame, left: str = "left_width_m", right: str = "right_width_m") -> DataFrame:
    """Infer the missing side of short one-sided runs from the total width of complete bins around them."""
    lw, rw = F.col(left), F.col(right)
    p = profile.withColumn("side", F.when((lw <= 0) & (rw > 0), "left").when((rw <= 0) & (lw > 0), "right"))
    change = ~F.lag("side").over(_along()).eqNullSafe(F.col("side"))
    p = p.withColumn("run", F.sum(change.cast("int")).over(_along()))
    p = p.withColumn("run_len", F.count(F.lit(1)).over(Window.partitionBy("track_id", "run")))
    complete = (lw > 0) & (rw > 0) & ((F.col("status") == "complete") | (F.col("confidence") >= 0.75))
    near = F.array_sort(F.collect_list(F.when(complete, lw + rw)).over(_along().rowsBetween(-INFER_WINDOW, INFER_WINDOW)))
    p = p.withColumn("totals", near).withColumn("k", F.size("totals"))
    at = lambda i: F.get(F.col("totals"), i.cast("int"))
    median = (at(F.floor((F.col("k") - 1) / 2)) + at(F.floor(F.col("k") / 2))) / 2
    width = median - F.when(F.col("side") == "left", rw).otherwise(lw)
    ok = F.col("side").isNotNull() & (F.col("run_len") <= INFER_MAX_RUN) & (F.col("k") >= INFER_MIN_NEIGHBOURS) & (width > 0)
    return p.withColumn("inferred_side", F.when(ok, F.col("side"))).withColumn("inferred_width_m", F.when(ok, width)).withColumn(
        "inferred_confidence", F.when(ok, F.lit(INFER_CONFIDENCE))).drop("side", "run", "run_len", "totals", "k")


def centre_path(frames: DataFrame, bin_m: float = 1.0) -> DataFrame:
    """Mean position per distance bin, without gap filling."""
    d, x, z = F.col("raw_lap_distance_m"), F.col("pos_x_m"), F.col("pos_z_m")
    ok = ~F.isnan(d) & ~F.isnan(x) & ~F.isnan(z)
    return frames.filter(F.coalesce(ok, F.lit(False))).groupBy(*TRACK, (F.floor(d / bin_m) * bin_m).alias("s_m")).agg(
        F.avg("pos_x_m").alias("x_m"), F.avg("pos_z_m").alias("z_m"), F.count(F.lit(1)).alias("samples"))


def boundaries(path: DataFrame, profile: DataFrame, left: Column, right: Column) -> DataFrame:
    """Left and right boundary points: the path offset along its normal by the given widths.

    Path points without a profile bin are kept with ``matched`` false and no positions, for counting.
    """
    lead = lambda c: F.coalesce(F.lead(c).over(_along()), F.col(c))
    lag = lambda c: F.coalesce(F.lag(c).over(_along()), F.col(c))
    p = path.withColumn("dx", lead("x_m") - lag("x_m")).withColumn("dz", lead("z_m") - lag("z_m"))
    length = F.hypot("dx", "dz")
    p = p.withColumn("nx", F.when(length >= 1e-12, -F.col("dz") / length).otherwise(0.0)).withColumn(
        "nz", F.when(length >= 1e-12, F.col("dx") / length).otherwise(0.0))
    j = p.join(profile.withColumn("lw", left).withColumn("rw", right).withColumn("matched", F.lit(True)), [*TRACK, "s_m"], "left")
    return j.withColumn("matched", F.coalesce("matched", F.lit(False))).withColumns({
        "left_x": F.col("x_m") + F.col("nx") * F.col("lw"), "left_z": F.col("z_m") + F.col("nz") * F.col("lw"),
        "right_x": F.col("x_m") - F.col("nx") * F.col("rw"), "right_z": F.col("z_m") - F.col("nz") * F.col("rw"),
    })


def _power_sums(column: str):
    """Step of the fit: sums of t^k and t^k·y over the neighbours, t counted from the point itself."""

    def add(a: Column, r: Column) -> Column:
        t = r["s_m"] - F.col("s_m")
        y = r[column]
        powers = {"n": F.lit(1.0), "t1": t, "t2": t * t, "t3": t * t * t, "t4": t * t * t * t, "y": y, "ty": t * y, "t2y": t * t * y}
        return F.struct(*[(a[k] + v).alias(k) for k, v in powers.items()])

    return add


def smooth_boundary(points: DataFrame, width: str, cols: Sequence[str], window: int, bin_m: float = 1.0) -> DataFrame:
    """Local quadratic fit of a boundary at each point, over ±``window`` points of the same stretch.

    Stretches end at zero width and at gaps of more than two bins.
    """
    gap = F.col("s_m") - F.lag("s_m").over(_along()) > 2 * bin_m
    barrier = F.col(width) == 0
    cut = barrier | F.coalesce(gap, F.lit(False)) | F.coalesce(F.lag(width).over(_along()) == 0, F.lit(False))
    p = points.withColumn("part", F.sum(cut.cast("int")).over(_along()))
    near = Window.partitionBy("track_id", "part").orderBy("s_m").rowsBetween(-window, window)
    p = p.withColumn("near", F.collect_list(F.struct("s_m", *cols)).over(near))
    for c in cols:
        zero = F.struct(*[F.lit(0.0).alias(k) for k in ("n", "t1", "t2", "t3", "t4", "y", "ty", "t2y")])

        m = F.aggregate("near", zero, _power_sums(c))
        p = p.withColumn("m", m)
        n, t1, t2, t3, t4 = (F.col(f"m.{k}") for k in ("n", "t1", "t2", "t3", "t4"))
        y, ty, t2y = (F.col(f"m.{k}") for k in ("y", "ty", "t2y"))
        det = n * (t2 * t4 - t3 * t3) - t1 * (t1 * t4 - t2 * t3) + t2 * (t1 * t3 - t2 * t2)
        det_a = y * (t2 * t4 - t3 * t3) - t1 * (ty * t4 - t3 * t2y) + t2 * (ty * t3 - t2 * t2y)
        fit = (F.size("near") >= 3) & (F.abs(det) >= 1e-9) & ~barrier
        p = p.withColumn(f"{c}_smooth", F.when(fit, det_a / det).otherwise(F.col(c)))
    return p.drop("part", "near", "m")


def resample_polyline(points: DataFrame, keys: Sequence[str], order: str, n: int, chunk_rows: int = 65536) -> DataFrame:
    """``n`` points at equal arc length along each polyline (columns x, y); a polyline of no length gives its first point.

    ``order`` numbers the rows, so that a chunk holds ``chunk_rows`` of them.
    """
    keys = list(keys)
    p = scan(points.select(*keys, order, "x", "y"), keys, order, prev={"x0": "x", "y0": "y"}, chunk_rows=chunk_rows)
    p = p.withColumn("d", F.coalesce(F.hypot(F.col("x") - F.col("x0"), F.col("y") - F.col("y0")), F.lit(0.0)))
    p = materialise(scan(p, keys, order, sums={"cum": "d"}, chunk_rows=chunk_rows))
    total = p.groupBy(*keys).agg(F.max("cum").alias("total"))
    p = p.join(total, keys).withColumn("cum0", F.col("cum") - F.col("d"))
    step = F.col("total") / (n - 1)
    is_first = F.col("x0").isNull()
    start = p.filter(is_first).select(*keys, F.lit(0).alias("i"), "x", "y")
    # The last point is the end of the line itself, whatever the running sums have rounded to.
    end = p.filter("total > 0").groupBy(*keys).agg(F.max_by(F.struct("x", "y"), F.col(order)).alias("e")).select(
        *keys, F.lit(n - 1).alias("i"), "e.x", "e.y")
    lo, hi = F.greatest(F.lit(1), F.floor(F.col("cum0") / step)), F.least(F.lit(n - 2), F.ceil(F.col("cum") / step))
    seg = p.filter(~is_first & (F.col("d") > 0)).withColumn("lo", lo.cast("int")).withColumn("hi", hi.cast("int"))
    seg = seg.filter("lo <= hi").withColumn("i", F.explode(F.sequence("lo", "hi")))
    target = F.col("i") / (n - 1) * F.col("total")
    inside = (target > F.col("cum0")) & (target <= F.col("cum"))
    t = (target - F.col("cum0")) / F.col("d")
    rest = seg.filter(inside).select(
        *keys, "i", (F.col("x0") + t * (F.col("x") - F.col("x0"))).alias("x"), (F.col("y0") + t * (F.col("y") - F.col("y0"))).alias("y"))
    return start.unionByName(rest).unionByName(end)


def median_outline(points: DataFrame, laps: DataFrame, by: Sequence[str], n: int = 500, fastest: int = 5) -> DataFrame:
    """Pointwise median of the resampled fastest laps of each ``by`` (needs at least two)."""
    w = Window.partitionBy(*by).orderBy("lap_time_s", *LAP)
    chosen = laps.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= fastest).select(*by, *LAP)
    r = resample_polyline(points.join(chosen, LAP), [*by, *LAP], "frame_id", n)
    return r.groupBy(*by, "i").agg(
        F.percentile("x", 0.5).alias("x"), F.percentile("y", 0.5).alias("y"), F.count(F.lit(1)).alias("laps")).filter("laps >= 2")


def ring_boundaries(ring: DataFrame, keys: Sequence[str], order: str = "i", width_m: float = 5.0) -> DataFrame:
    """Constant-width boundaries of a closed ring; neighbours wrap around."""
    w = Window.partitionBy(*keys).orderBy(order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    prev = lambda c: F.coalesce(F.lag(c).over(w), F.last(c).over(whole))
    nxt = lambda c: F.coalesce(F.lead(c).over(w), F.first(c).over(whole))
    r = ring.withColumn("dx", nxt("x") - prev("x")).withColumn("dy", nxt("y") - prev("y"))
    length = F.hypot("dx", "dy")
    nx = F.when(length == 0, 0.0).otherwise(-F.col("dy") / length)
    ny = F.when(length == 0, 1.0).otherwise(F.col("dx") / length)
    return r.withColumns({
        "left_x": F.col("x") - nx * width_m, "left_y": F.col("y") - ny * width_m,
        "right_x": F.col("x") + nx * width_m, "right_y": F.col("y") + ny * width_m,
    }).drop("dx", "dy")


def ring_edges(ring: DataFrame, keys: Sequence[str], order: str = "i") -> DataFrame:
    """Edges of a closed ring, the closing one included."""
    w = Window.partitionBy(*keys).orderBy(order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nxt = lambda c: F.coalesce(F.lead(c).over(w), F.first(c).over(whole))
    return ring.select(*keys, order, F.col("x").alias("x1"), F.col("y").alias("y1"), nxt("x").alias("x2"), nxt("y").alias("y2"))


def ring_length(ring: DataFrame, keys: Sequence[str], order: str = "i") -> DataFrame:
    e = ring_edges(ring, keys, order)
    return e.groupBy(*keys).agg(F.sum(F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))).alias("length_m"))


def inside_ring(points: DataFrame, edges: DataFrame, keys: Sequence[str], px: str, py: str) -> DataFrame:
    """Points with ``inside``: the parity of ring edges to the right of the point.

    Only edges whose y range holds the point are met, through the bucketed range join.
    """
    e = edges.withColumn("y_lo", F.least("y1", "y2")).withColumn("y_hi", F.greatest("y1", "y2")).filter("y_lo < y_hi")
    hit = range_join(points, e.select(*keys, "x1", "y1", "x2", "y2", "y_lo", "y_hi"), list(keys), py, "y_lo", "y_hi", include_hi=False, how="left")
    cross = F.col("x1") + (F.col(py) - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))
    return hit.groupBy(*points.columns).agg((F.count_if(F.col(px) < cross) % 2 == 1).alias("inside"))


def baked_turns(reference: DataFrame, corners: DataFrame, ring: DataFrame) -> DataFrame:
    """Apex position, tangent and outward normal of each corner on the reference lap.

    ``reference``: frames of the reference lap per track; ``ring``: closed centreline (track_id, i, x, y).
    """
    offsets = F.explode(F.array(F.lit(-TANGENT_WINDOW_M), F.lit(0.0), F.lit(TANGENT_WINDOW_M)))
    t = corners.select("track_id", "corner_id", "corner_pos", "apex_s_m", offsets.alias("off")).withColumn("target_s_m", F.col("apex_s_m") + F.col("off"))
    found = lookup(reference, t.select("track_id", "target_s_m"), ["track_id"], ["track_id"], ["pos_x_m", "pos_z_m"])
    at = lambda off, c: F.max(F.when(F.col("off") == off, F.col(c)))
    p = t.join(found, ["track_id", "target_s_m"]).groupBy("track_id", "corner_id", "corner_pos", "apex_s_m").agg(
        at(0.0, "pos_x_m").alias("x"), at(0.0, "pos_z_m").alias("y"),
        (at(TANGENT_WINDOW_M, "pos_x_m") - at(-TANGENT_WINDOW_M, "pos_x_m")).alias("dx"),
        (at(TANGENT_WINDOW_M, "pos_z_m") - at(-TANGENT_WINDOW_M, "pos_z_m")).alias("dy"))
    norm = F.when(F.hypot("dx", "dy") == 0, 1.0).otherwise(F.hypot("dx", "dy"))
    p = p.withColumn("tx", F.col("dx") / norm).withColumn("ty", F.col("dy") / norm)
    p = p.withColumn("px", F.col("x") - F.col("ty") * PROBE_M).withColumn("py", F.col("y") + F.col("tx") * PROBE_M)
    p = p.withColumn("qx", F.col("x") + F.col("ty") * PROBE_M).withColumn("qy", F.col("y") - F.col("tx") * PROBE_M)
    edges = ring_edges(ring, ["track_id"])
    one = inside_ring(p, edges, ["track_id"], "px", "py").withColumnRenamed("inside", "left_inside")
    both = inside_ring(one, edges, ["track_id"], "qx", "qy").withColumnRenamed("inside", "right_inside")
    # The first side whose probe lies outside the ring; the left normal when neither does.
    use_right = F.col("left_inside") & ~F.col("right_inside")
    return both.select(
        "track_id", "corner_id", "corner_pos", F.round("apex_s_m", 1).alias("apex_s_m"), F.round("x", 3).alias("x"), F.round("y", 3).alias("y"),
        F.round(F.when(use_right, F.col("ty")).otherwise(-F.col("ty")), 4).alias("out_x"),
        F.round(F.when(use_right, -F.col("tx")).otherwise(F.col("tx")), 4).alias("out_y"),
        F.round("tx", 4).alias("tan_x"), F.round("ty", 4).alias("tan_y"))


def start_alignment(recorded: DataFrame, ring: DataFrame) -> DataFrame:
    """Recorded map point nearest the centreline start (its y axis is mirrored), and its offset along the lap.

    ``recorded``: track_id, i, x, y, distance_m.
    """
    start = ring.filter("i = 0").select("track_id", F.col("x").alias("sx"), F.col("y").alias("sy"))
    gap = F.hypot(F.col("x") - F.col("sx"), F.col("y") + F.col("sy"))
    g = recorded.join(start, "track_id").groupBy("track_id").agg(
        F.min(F.struct(gap.alias("gap"), "i", "distance_m")).alias("near"), F.count(F.lit(1)).alias("points"),
        F.max("distance_m").alias("length"), F.min_by("distance_m", "i").alias("d0"))
    along = F.pmod(F.col("near.distance_m") - F.col("d0"), F.col("length"))
    return g.select(
        "track_id", F.col("near.i").alias("shift"), "points", F.col("near.gap").alias("start_offset_m"),
        F.least(along, F.col("length") - along).alias("axis_offset_m"), (F.col("length") / F.col("points")).alias("point_spacing_m"))


def rotate_ring(recorded: DataFrame, alignment: DataFrame) -> DataFrame:
    """Indices counted from the aligned start."""
    return recorded.join(alignment.select("track_id", "shift", "points"), "track_id").withColumn(
        "i_rotated", F.pmod(F.col("i") - F.col("shift"), F.col("points"))).drop("shift", "points")


def similarity_fit(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Scale, rotation and translation that best map (x, y) onto (u, v)."""
    c = pairs.groupBy(*keys).agg(*[F.avg(k).alias(f"m{k}") for k in ("x", "y", "u", "v")])
    p = pairs.join(c, list(keys))
    x, y, u, v = (F.col(k) - F.col(f"m{k}") for k in ("x", "y", "u", "v"))
    s = p.groupBy(*keys).agg(
        F.sqrt(F.avg(x * x + y * y)).alias("src"), F.sqrt(F.avg(u * u + v * v)).alias("dst"),
        F.sum(x * v - y * u).alias("num"), F.sum(x * u + y * v).alias("den"), *[F.max(f"m{k}").alias(f"m{k}") for k in ("x", "y", "u", "v")])
    s = s.withColumn("scale", F.when(F.col("src") > 0, F.col("dst") / F.col("src")).otherwise(1.0)).withColumn("rotation_rad", F.atan2("num", "den"))
    cos, sin = F.cos("rotation_rad"), F.sin("rotation_rad")
    return s.select(
        *keys, "scale", "rotation_rad",
        (F.col("mu") - F.col("scale") * (F.col("mx") * cos - F.col("my") * sin)).alias("translate_x"),
        (F.col("mv") - F.col("scale") * (F.col("mx") * sin + F.col("my") * cos)).alias("translate_y"))


def apply_similarity(points: DataFrame, fit: DataFrame, keys: Sequence[str]) -> DataFrame:
    cos, sin = F.cos("rotation_rad"), F.sin("rotation_rad")
    return points.join(fit, list(keys)).withColumn(
        "fit_x", F.col("scale") * (F.col("x") * cos - F.col("y") * sin) + F.col("translate_x")).withColumn(
        "fit_y", F.col("scale") * (F.col("x") * sin + F.col("y") * cos) + F.col("translate_y"))


def heat_table(grid: DataFrame, channel: str, own_range: bool) -> DataFrame:
    """Normalised channel per 2 m piece of each lap; speed by its own range, pedals by 0–1."""
    w = Window.partitionBy(*LAP).orderBy("s_m")
    whole = Window.partitionBy(*LAP)
    v = F.col(channel)
    g = grid.withColumn("value", F.lead(v, HEAT_STEP_M // 2).over(w))
    for c in ("pos_x_m", "pos_z_m"):
        g = g.withColumn(f"{c}_to", F.lead(c, HEAT_STEP_M).over(w))
    lo, hi = (F.min(v).over(whole), F.max(v).over(whole)) if own_range else (F.lit(0.0), F.lit(1.0))
    g = g.withColumn("lo", lo).withColumn("hi", hi)
    flat = F.col("lo").isNull() | (F.col("hi") <= F.col("lo"))
    lo2, hi2 = F.when(flat, 0.0).otherwise(F.col("lo")), F.when(flat, 1.0).otherwise(F.col("hi"))
    norm = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("value") - lo2) / (hi2 - lo2)))
    return g.filter((F.col("s_m") % HEAT_STEP_M == 0) & F.col("pos_x_m_to").isNotNull() & F.col("value").isNotNull()).withColumn("heat", norm)


def export_summary(profile: DataFrame) -> DataFrame:
    """Counts that accompany an exported width profile."""
    return profile.groupBy(*TRACK).agg(
        F.count(F.lit(1)).alias("samples"), *[F.count_if(F.col("status") == s).alias(f"{s.replace('-', '_')}_bins")
                                             for s in ("missing", "one-sided", "low-sample", "complete")])
