"""Incremental import as a stream."""
