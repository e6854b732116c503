"""Drift, evaluation and promotion-gate analytics as plain Spark plans."""
