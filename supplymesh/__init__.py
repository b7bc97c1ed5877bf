"""Spark-first analytics for multi-tier supplier networks."""
