"""Materialized views: bitemporal logs, row deltas, rewrites, refresh."""
