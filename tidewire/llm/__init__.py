"""Training-data operators: deduplication, decontamination, scoring, tokenising, formatting.

Nothing outside this subpackage imports it.  ``queries.py`` holds the registered
queries and their SQL.
"""
