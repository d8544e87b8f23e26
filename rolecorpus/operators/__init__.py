"""Keyed merges, de-duplication, retrieval, scoring, stores, digests, owners, telemetry and evaluation."""
