"""Telemetry analytics on Spark: laps, metre-grid alignment, corner facts, track geometry, live detection."""
