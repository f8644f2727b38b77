"""Spark jobs for cadastral map data, and (in ``llm``) for training-data corpora."""
