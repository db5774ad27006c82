"""Incremental upkeep of quality figures from a stream of runs."""
