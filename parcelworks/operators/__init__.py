"""Operators on DataFrames: predicates, joins, aggregations, windows, searches, alignment."""
