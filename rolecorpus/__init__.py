"""Posting-corpus curation, batch retrieval and search telemetry as Spark jobs."""
