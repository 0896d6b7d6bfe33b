"""Reusable DataFrame steps: joins, rollups, filters, row numbers, ranking."""
