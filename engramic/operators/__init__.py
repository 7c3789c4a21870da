"""Relational operators over memories, series, metrics, clusters, caches and workers."""
