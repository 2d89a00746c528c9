"""Advice text, targets and live routing on hand-made facts."""

from pyspark.sql import functions as F

from pacetrace.operators import session_stats as st
from pacetrace.streaming import detectors as dt

PHASES = (
    "session_id string, segment_index int, corner_id int, corner_name string, corner_pos int, apex_s_m double, phase string, loss_s double, "
    "driver_value double, reference_value double, entry_distance_delta_m double, exit_distance_delta_m double, phase_distance_m double"
)


def build(spark, state="no_detected_instability", overlap=False, gears=(3, 2)):
    rows = []
    for lap in range(4):
        rows.append(("s", lap, 1, "One", 0, 100.0, "minimum_speed", 0.40, 90.0, 96.0, None, None, None))
        rows.append(("s", lap, 1, "One", 0, 100.0, "entry", 0.10, 190.0, 196.0, 12.0, None, 50.0))
        rows.append(("s", lap, 2, "Two", 1, 300.0, "exit", 0.05 + 0.1 * lap, 120.0, 121.5, None, 7.0, 350.0))
    phases = spark.createDataFrame(rows, PHASES)
    gaps = spark.createDataFrame([("s", 1.0)], "session_id string, mean_gap_s double")
    ranked = st.priorities(phases, gaps)
    gear = lambda g: spark.createDataFrame([("s", 1, g, 0.0, 0.0)], "session_id string, corner_id int, gear_at_apex int, trail_brake_depth_m double, lateral_at_apex_m double")
    rear = spark.createDataFrame(
        [("s", 1, state, overlap, 5.0, 4.8, 2.0, 3.0, 3, 3, True)],
        "session_id string, corner_id int, state string, brake_overlap boolean, value_deg double, braking_deg double, baseline_deg double, "
        "threshold_deg double, worst_segment int, worst_lap int, worst_clean boolean")
    return phases, ranked, gear(gears[0]), gear(gears[1]), rear


def advice(spark, **kw):
    return {r["corner_id"]: r for r in st.suggested_changes(*build(spark, **kw)).collect()}


def test_priorities_and_clauses(spark):
    a = advice(spark)
    assert (a[1]["rank"], a[1]["phase"], a[1]["kind"]) == (1, "minimum_speed", "recurring")
    assert (a[2]["rank"], a[2]["kind"], round(a[2]["spread_s"], 6)) == (2, "both", 0.3)
    assert a[1]["suggestion"] == "carry 6 km/h more minimum speed and one gear lower at the apex (2nd, not 3rd)"
    assert a[2]["suggestion"] == "get back on the throttle 7 m earlier and carry 2 km/h more speed onto the straight"


def test_a_sliding_rear_replaces_the_request_for_more(spark):
    text = advice(spark, state="measured_instability", overlap=True)[1]["suggestion"]
    assert text.startswith("the rear slid under braking on segment 3 (lap 3): 5.00 deg") and "minimum speed" not in text
    soft = advice(spark, state="measured_instability", overlap=False)[1]["suggestion"]
    assert soft.startswith("the rear slipped") and soft.endswith("carry 6 km/h more minimum speed")


def test_targets_state_a_deficit(spark):
    phases, ranked, mine, theirs, rear = build(spark)
    t = st.next_targets(ranked, mine, theirs, rear).orderBy("rank").collect()
    assert t[0]["measure"] == "96.0 km/h at the apex, against 90.0 today; 2nd gear at the apex, against 3rd today"
    assert t[1]["measure"] == "121.5 km/h onto the straight, against 120.0 today"


def test_routing(spark):
    e = spark.createDataFrame([("lap_completed",), ("corner_exit",), ("new_lap",)], "event string")
    got = {m: sorted((r["event"], r["top_n"], r["max_words"]) for r in dt.route(e, m).collect()) for m in dt.MODES}
    assert got == {"off": [], "lap": [("lap_completed", 3, 35)], "turn": [("corner_exit", 1, 20)], "all": [("corner_exit", 1, 20), ("lap_completed", 3, 35)]}


def test_reply_check(spark):
    rows = [("You lose 0.7 s in turn 3. Does it slide?", "0.702 3"), ("You lose 4.7 s", "0.702"), ("1:19.135 was best. Ok?", "79.135")]
    r = st.reply_warnings(spark.createDataFrame(rows, "reply string, facts string")).collect()
    assert [x["invented"] for x in r] == ["", "4.7", ""]
    assert [x["questions"] for x in r] == [1, 0, 1] and [x["truncated"] for x in r] == [False, True, False]
    assert spark.range(1).select(st.is_meta_output(F.lit(" - x")), st.is_meta_output(F.lit("Brake later."))).collect()[0][:] == (True, False)
