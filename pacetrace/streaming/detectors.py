"""The rules of the live detectors as batch plans over the chunked ordered operators; ``live`` has the streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordered import CHUNK_ROWS, run_pieces, scan, tag_runs
from ..functions.storage import materialise
from ..operators.session_stats import fuel_status

# Fixed values of the detectors.
IDLE_S = 5.0
RESTART_S = 30.0
COOLDOWN_S = 8.0
MAX_STEP_S = 0.5
STALL_S = 0.3
SOURCE = ["source_id"]


# ---------------------------------------------------------------- session rotation

def rotate_sessions(frames: DataFrame, idle_s: float = IDLE_S, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Number the sessions of each source: a new one on track or vehicle change, idle time, or a clock that
    falls back.  Needs source_id, frame_id, arrival_s, session_time_s, track_name, vehicle_name."""
    f = scan(frames, SOURCE, "frame_id", chunk_rows=chunk_rows, prev={
        "p_track": "track_name", "p_vehicle": "vehicle_name", "p_clock": "session_time_s", "p_arrival": "arrival_s"})
    new = (
        F.col("p_track").isNull() | (F.col("track_name") != F.col("p_track")) | (F.col("vehicle_name") != F.col("p_vehicle"))
        | (F.col("session_time_s") < F.col("p_clock") - RESTART_S) | (F.col("arrival_s") - F.col("p_arrival") >= idle_s)
    )
    f = f.withColumn("is_start", F.coalesce(new, F.lit(False)))
    f = scan(f, SOURCE, "frame_id", sums={"session_no": F.col("is_start").cast("int")}, chunk_rows=chunk_rows)
    return f.drop("p_track", "p_vehicle", "p_clock", "p_arrival")


# ---------------------------------------------------------------- lap events

def lap_events(frames: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Lap starts and completions per source; ``frame_id`` is the frame at which the event is known.

    A lap completes when its number goes forward on the same track; otherwise it is dropped.
    """
    key = F.struct("track_name", "lap_number")
    pieces = materialise(run_pieces(frames, SOURCE, "frame_id", key, chunk_rows=chunk_rows))
    tagged = tag_runs(frames, pieces, SOURCE, "frame_id", {"run_index": "run"}, chunk_rows)
    runs = tagged.groupBy(*SOURCE, "run").agg(
        F.min("frame_id").alias("start"), F.count(F.lit(1)).alias("frames"), F.max_by("lap_time_s", "frame_id").alias("last_time"),
        F.min("lap_number").alias("lap_number"), F.min("track_name").alias("track_name"))
    w = Window.partitionBy(*SOURCE).orderBy("run")
    nxt = {c: F.lead(c).over(w) for c in ("lap_number", "track_name", "start")}
    runs = runs.withColumns({f"n_{c}": e for c, e in nxt.items()})
    begun = runs.select(*SOURCE, F.col("start").alias("frame_id"), F.lit("new_lap").alias("event"), "lap_number",
                        F.lit(None).cast("double").alias("lap_time_s"), F.lit(None).cast("long").alias("frame_count"))
    done = runs.filter((F.col("n_track_name") == F.col("track_name")) & (F.col("n_lap_number") > F.col("lap_number"))).select(
        *SOURCE, F.col("n_start").alias("frame_id"), F.lit("lap_completed").alias("event"), "lap_number",
        F.col("last_time").alias("lap_time_s"), F.col("frames").alias("frame_count"))
    return begun.unionByName(done)


# ---------------------------------------------------------------- corner exits

def corner_exits(placed: DataFrame, cooldown_s: float = COOLDOWN_S, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Corner exits per source after its first completed lap on a track, at most one per cooldown.

    ``placed``: frames with corner_id and corner_end_m of the corner they are in, and track_name where a source may change
    its track, on which everything starts anew.  Exits closer than the cooldown form chains; a chain starts after a quiet
    gap, so chains are independent.
    """
    by = SOURCE
    if "track_name" in placed.columns:
        by = [*SOURCE, "track_run"]
        pieces = materialise(run_pieces(placed, SOURCE, "frame_id", "track_name", chunk_rows=chunk_rows))
        placed = tag_runs(placed, pieces, SOURCE, "frame_id", {"run_index": "track_run"}, chunk_rows)
    f = scan(placed, by, "frame_id", chunk_rows=chunk_rows, prev={
        "p_corner": "corner_id", "p_end": "corner_end_m", "p_lap": "lap_number"})
    ahead = F.col("lap_number") > F.col("p_lap")
    # Exits count from the first completed lap on: one frame number per source.
    first_done = f.groupBy(*by).agg(F.min(F.when(ahead, F.col("frame_id"))).alias("first_done"))
    f = f.join(first_done, by)
    same_lap = F.col("lap_number") == F.col("p_lap")
    left = F.col("corner_id").isNull() | ((F.col("corner_id") != F.col("p_corner")) & (F.col("lap_distance_m") >= F.col("p_end")))
    c = f.filter((F.col("frame_id") >= F.col("first_done")) & same_lap & F.col("p_corner").isNotNull() & left).select(
        *by, "frame_id", "lap_number", "session_time_s", F.col("p_corner").alias("exited_corner"),
        F.when(F.col("corner_id").isNull(), F.col("lap_distance_m")).otherwise(F.col("p_end")).alias("exit_distance_m"))
    c = materialise(c)  # a few rows per lap
    c = scan(c, by, "frame_id", chunk_rows=chunk_rows, prev={"p_time": "session_time_s"})
    fresh = F.coalesce(F.col("session_time_s") - F.col("p_time") >= cooldown_s, F.lit(True))
    c = scan(c, by, "frame_id", chunk_rows=chunk_rows, sums={"chain": fresh.cast("int")})
    items = F.array_sort(F.collect_list(F.struct("session_time_s", "frame_id", "lap_number", "exited_corner", "exit_distance_m")))
    keep = F.aggregate(
        F.slice("items", F.lit(2), F.greatest(F.size("items") - 1, F.lit(0))), F.slice("items", 1, 1),
        lambda acc, x: F.when(x["session_time_s"] - F.element_at(acc, -1)["session_time_s"] >= cooldown_s, F.concat(acc, F.array(x))).otherwise(acc))
    return c.groupBy(*by, "chain").agg(items.alias("items")).select(*SOURCE, F.explode(keep).alias("x")).select(*SOURCE, "x.*")


# ---------------------------------------------------------------- dead reckoning, fuel, routing

def estimated_distance(frames: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Distance between raw updates: the last raw value plus speed times arrival time since then.

    A row is an anchor when the raw distance changes, time steps are unusable or the simulation clock stalls.
    """
    f = scan(frames, SOURCE, "frame_id", chunk_rows=chunk_rows, prev={"p_raw": "raw_distance_m", "p_arrival": "arrival_s", "p_clock": "session_time_s"})
    dt = F.col("arrival_s") - F.col("p_arrival")
    tick = F.when(F.col("session_time_s") != F.col("p_clock"), F.col("arrival_s"))
    f = scan(materialise(f), SOURCE, "frame_id", chunk_rows=chunk_rows, fill={"last_tick": tick})
    running = F.coalesce(F.col("arrival_s") - F.col("last_tick") < STALL_S, F.lit(False))
    anchor = F.col("p_arrival").isNull() | (dt <= 0) | (dt > MAX_STEP_S) | ~running | (F.col("raw_distance_m") != F.col("p_raw"))
    f = f.withColumn("is_anchor", anchor).withColumn("run_m", F.when(anchor, 0.0).otherwise(F.col("speed_mps") * dt))
    f = scan(f, SOURCE, "frame_id", chunk_rows=chunk_rows, sums={"total_m": "run_m"})
    mark = F.when(F.col("is_anchor"), F.struct(F.col("raw_distance_m").alias("raw"), F.col("total_m").alias("at")))
    f = scan(materialise(f), SOURCE, "frame_id", chunk_rows=chunk_rows, fill={"anchor": mark})
    return f.withColumn("estimated_m", F.col("anchor.raw") + F.col("total_m") - F.col("anchor.at")).drop(
        "p_raw", "p_arrival", "p_clock", "last_tick", "run_m", "total_m", "anchor")


def fuel_by_lap(seg_frames: DataFrame) -> DataFrame:
    """Fuel state after every segment, from per-segment first and last readings carried along the session."""
    fuel, cap = F.col("fuel_l"), F.col("fuel_capacity_l")
    order = F.when((fuel > 0) & ~F.coalesce((cap > 0) & (fuel > cap), F.lit(False)), F.col("frame_id"))
    g = seg_frames.groupBy("session_id", "segment_index").agg(
        F.min("lap_number").alias("lap_number"), F.count(order).alias("n"),
        F.min_by("fuel_l", order).alias("first_l"), F.max_by("fuel_l", order).alias("last_l"))
    w = Window.partitionBy("session_id").orderBy("segment_index")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    seen = F.row_number().over(Window.partitionBy("session_id", "lap_number").orderBy("segment_index")) == 1
    g = g.withColumn("is_new", seen.cast("int"))
    has = F.col("n") > 0
    g = g.withColumn("start_l", F.first(F.when(has, F.col("first_l")), True).over(upto)).withColumn(
        "end_l", F.last(F.when(has, F.col("last_l")), True).over(upto)).withColumn("laps_completed", F.sum("is_new").over(upto))
    used = F.col("start_l") - F.col("end_l")
    g = g.withColumn("per_lap_l", F.when(used > 0, used / F.col("laps_completed")))
    g = g.withColumn("laps_left", F.when(F.col("per_lap_l") > 0, F.col("end_l") / F.col("per_lap_l")))
    return g.withColumn("fuel_status", fuel_status(F.col("laps_left"))).drop("n", "first_l", "last_l", "is_new")


# What each live mode lets through, how many facts it states and in how many words.
MODES = {"off": (), "lap": ("lap_completed",), "turn": ("corner_exit",), "all": ("lap_completed", "corner_exit")}
FACTS_PER_EVENT = {"lap_completed": 3, "corner_exit": 1}
WORDS_PER_EVENT = {"lap_completed": 35, "corner_exit": 20}


def route(events: DataFrame, mode: str) -> DataFrame:
    """Events the mode lets through, with their fact count and word cap."""
    def pick(table: dict[str, int]) -> Column:
        out = F.lit(None).cast("int")
        for name, n in table.items():
            out = F.when(F.col("event") == name, n).otherwise(out)
        return out

    return events.filter(F.col("event").isin(*MODES[mode]) if MODES[mode] else F.lit(False)).withColumn(
        "top_n", pick(FACTS_PER_EVENT)).withColumn("max_words", pick(WORDS_PER_EVENT))
