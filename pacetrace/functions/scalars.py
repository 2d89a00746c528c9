"""Column expressions: slugs, labels, sentinel cleaning and small conversions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _latin_table() -> tuple[str, str]:
    """Accented Latin letters and their base letter, from the Unicode decomposition."""
    src, dst = [], []
    for cp in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base = "".join(c for c in unicodedata.normalize("NFKD", chr(cp)) if not unicodedata.combining(c))
        if base != chr(cp) and len(base) == 1 and base.isascii():
            src.append(chr(cp))
            dst.append(base)
    return "".join(src), "".join(dst)


_ACCENTED, _PLAIN = _latin_table()


def track_slug(c: Column) -> Column:
    """Accent-free, lower-case, dashes for spaces; ``unknown`` when nothing is left."""
    plain = F.lower(F.translate(c, _ACCENTED, _PLAIN))
    slug = F.regexp_replace(F.regexp_replace(plain, " ", "-"), "[^a-z0-9-]", "")
    return F.when(F.coalesce(slug, F.lit("")) == "", F.lit("unknown")).otherwise(slug)


def vehicle_slug(c: Column) -> Column:
    s = F.regexp_replace(F.regexp_replace(F.lower(c), "#", ""), "[:/]", "-")
    s = F.regexp_replace(F.regexp_replace(s, r"\s+", "-"), "-+", "-")
    return F.regexp_replace(s, "^-|-$", "")


def session_type_label(code: Column) -> Column:
    return (
        F.when(code.between(10, 13), "race").when(code.between(5, 8), "quali")
        .when(code.between(0, 4) | (code == 9), "practice")
    )


# The fuel job's own session codes, which differ from the label above.
LEGACY_FUEL_TYPES = {0: "practice", 1: "test", 2: "qualifying", 3: "race", 4: "other", 5: "other", 6: "other", 7: "other", 8: "other"}


def fuel_session_type(code: Column, mapping: str = "label") -> Column:
    """Session type for fuel facts; ``mapping='legacy'`` uses the older code table."""
    if mapping == "legacy":
        table = F.create_map(*[F.lit(x) for kv in LEGACY_FUEL_TYPES.items() for x in kv])
        return F.coalesce(F.try_element_at(table, code), F.lit("unknown"))
    return F.coalesce(session_type_label(code), F.lit("unknown"))


def distance_to_edge(recorded: Column | None, edge: Column, lateral: Column) -> Column:
    """Recorded edge distance where finite, else edge minus the lateral offset."""
    computed = edge - F.abs(lateral)
    return computed if recorded is None else F.coalesce(F.when(~F.isnan(recorded), recorded), computed)


def not_negative(c: Column) -> Column:
    return F.when(c >= 0, c)


def positive(c: Column) -> Column:
    return F.when(c > 0, c)


def valid_session_type(c: Column) -> Column:
    return F.when(c.between(0, 13), c)


def finite(c: Column) -> Column:
    inf = F.lit(float("inf"))
    return F.when(~F.isnan(c) & (F.abs(c) != inf), c)


def recordable(paused: Column, track: Column, vehicle: Column) -> Column:
    """Not paused and both names known."""
    named = (F.coalesce(track, F.lit("")) != "") & (F.coalesce(vehicle, F.lit("")) != "")
    return ~F.coalesce(paused, F.lit(False)) & named


def slip_angle_deg(lateral: Column, longitudinal: Column) -> Column:
    return F.degrees(F.atan2(lateral, longitudinal))


def lap_time_text(seconds: Column) -> Column:
    """``m:ss.mmm``; a dash for no time."""
    ms = F.round(seconds * 1000).cast("long")
    text = F.format_string("%d:%06.3f", (ms / 60000).cast("long"), (ms % 60000) / F.lit(1000.0))
    return F.when(seconds.isNull(), F.lit("—")).otherwise(text)


def net_pedal(throttle: Column, brake: Column) -> Column:
    return F.coalesce(throttle, F.lit(0.0)) - F.coalesce(brake, F.lit(0.0))


def raw_distance(raw: Column, integrated: Column, fallback: bool) -> Column:
    """Raw distance where finite, else the integrated one if allowed."""
    return F.coalesce(finite(raw), finite(integrated)) if fallback else finite(raw)


def lap_fraction(distance: Column, lap_length: Column) -> Column:
    """Position as a share of the lap, clamped to 0–1; NULL when the lap length is not positive."""
    return F.when(lap_length > 0, F.least(F.greatest(distance / lap_length, F.lit(0.0)), F.lit(1.0)))


def apex_timing_label(error_m: Column) -> Column:
    size = F.format_string("%.1f m", F.abs(error_m))
    return (
        F.when(error_m.isNull(), F.lit("—")).when(error_m > 0, F.concat(size, F.lit(" late")))
        .when(error_m < 0, F.concat(size, F.lit(" early"))).otherwise(F.lit("exact"))
    )


def invalid_samples(frames: DataFrame) -> DataFrame:
    """First bad row per session and outline channel: NaN anywhere, or a negative track edge."""
    names = [c for c in ("raw_lap_distance_m", "path_lateral_m", "track_edge_m", "distance_to_track_edge_m") if c in frames.columns]
    aggs = []
    for c in names:
        bad = F.isnan(c) | (F.col(c) < 0) if c == "track_edge_m" else F.isnan(c)
        row = F.struct(F.col("frame_id").alias("first_bad_frame"), F.col(c).cast("double").alias("value"))
        aggs += [F.count_if(bad).alias(f"{c}_n"), F.min(F.when(bad, row)).alias(f"{c}_row")]
    items = F.array(*[
        F.struct(F.lit(c).alias("channel"), F.col(f"{c}_n").alias("bad_rows"), F.col(f"{c}_row.first_bad_frame").alias("first_bad_frame"),
                 F.col(f"{c}_row.value").alias("value"))
        for c in names
    ])
    return frames.groupBy("session_id").agg(*aggs).select("session_id", F.explode(items).alias("i")).select(
        "session_id", "i.*").filter("bad_rows > 0")
