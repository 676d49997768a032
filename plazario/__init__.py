"""Plazario: a Spark-first analytics engine for job postings."""
