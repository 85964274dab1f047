"""Condition-monitoring analytics on Spark: telemetry gates, windows, baselines, evidence and review levels."""
