"""Millrace: retrieval analytics as Spark plans."""
