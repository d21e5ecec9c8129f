"""Spark-first analytics over long documents, their spans and task outcomes."""
