"""Curation of JSON training data as Spark DataFrame jobs."""
