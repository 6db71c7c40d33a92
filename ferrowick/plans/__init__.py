"""What can be told about a query before it runs: names, determinism, lineage, gates, calendars, data quality."""
