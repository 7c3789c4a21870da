"""Scans, lookups, persistence."""
