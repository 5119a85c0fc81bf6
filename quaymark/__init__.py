"""Spark-first analytics over request-security feeds and telemetry."""
