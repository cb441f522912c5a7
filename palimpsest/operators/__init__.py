"""Relational operators of the engine; each takes and returns lazy DataFrames."""
