"""Feeds, pages, frontiers and tenants read from landed files."""
