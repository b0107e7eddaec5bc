"""Spark jobs over source-code corpora, decision logs and training text."""
