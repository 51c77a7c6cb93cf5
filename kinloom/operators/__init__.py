"""Joins, household aggregation, set operations, partitions."""
