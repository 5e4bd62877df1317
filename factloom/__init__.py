"""Spark-first analytics over facts, findings and text."""
