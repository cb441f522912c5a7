"""Whole queries: the store's facade, and the registered queries with their SQL."""
