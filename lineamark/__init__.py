"""Spark-first provenance and text-forensics engine."""
