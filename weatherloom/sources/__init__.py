"""Readings, current-reading payloads, generated readings, and stand-ins on the benchmark tables."""
