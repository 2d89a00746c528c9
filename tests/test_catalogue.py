"""Contract of the registry, a sample of queries against their SQL, and streams equal to batches."""

import pytest

import __spark_entry__ as entry
from tests.oracle import compare, make_duck

SF = "/root/testdata/sf0.001"
# One query per family here; ``python -m tests.oracle`` runs them all.
SAMPLE = ["lap_inventory", "lap_viewer_flags", "clock_smoothing", "distance_step", "corner_neighbour_bounds", "apex_metrics",
          "sharded_session_read", "reference_resolution", "speech_window", "width_profile", "profile_smoothing", "corner_matching",
          "fuel_facts", "reply_check", "estimated_distance"]


@pytest.fixture(scope="module")
def duck():
    return make_duck(SF)


def test_every_oracle_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) >= 100


def test_oracles_bind(duck):
    """Each SQL text is valid on the supplied tables."""
    for name, sql in entry.oracle_sql().items():
        duck.sql(f"EXPLAIN {sql}") if not sql.lstrip().upper().startswith("WITH RECURSIVE") else duck.sql(sql)
        assert name


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", SAMPLE)
def test_sample_matches_sql(spark, duck, name):
    got = entry.queries()[name](spark, SF).toArrow()
    assert compare(got, duck.sql(entry.oracle_sql()[name]).to_arrow_table()) is None


@pytest.mark.parametrize(("stream", "batch"), [("lap_event_stream", "lap_events"), ("corner_exit_stream", "corner_exits")])
def test_stream_equals_batch(spark, stream, batch):
    q = entry.queries()
    assert compare(q[stream](spark, SF).toArrow(), q[batch](spark, SF).toArrow()) is None
