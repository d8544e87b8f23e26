"""Training-data operators: de-duplication, search, privacy, language, quality, extraction and mixing.

Nothing outside this package imports it; ``queries.py`` holds the thin registered queries.
"""
