"""Operators for large-scale training-data pipelines, one module each.

Nothing outside this subpackage imports it; `queries` holds the registered
queries and their SQL.
"""
