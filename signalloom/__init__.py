"""Telemetry analytics on Spark: signal tables in, metrics, graphs, spans, profiles and findings out."""
