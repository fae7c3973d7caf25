"""Scans, sinks and the retail view over the supplied tables."""
