"""Structured Streaming forms of sessionizing, clustering and the store's sink."""
