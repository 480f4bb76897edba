"""Predicates, aggregates and conversions as Spark columns."""
