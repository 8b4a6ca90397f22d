"""Windowed sensor analytics on Spark: event-time windows, exact percentiles, batch and stream."""
