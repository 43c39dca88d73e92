"""Approximate aggregates over graph patterns with model predicates, on Spark."""
