"""Spark-native analytics over session transcripts: ingestion, retrieval, telemetry and record preparation."""
