"""Monitoring of readings as they arrive, with Structured Streaming."""
