"""Telemetry analytics on Spark: sessions, channels, laps and reports as DataFrames."""
