"""Spark-first analytics engine for conversational speech corpora."""
