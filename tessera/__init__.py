"""Spark jobs for telemetry rollups, context retrieval, signal extraction and model metrics."""
