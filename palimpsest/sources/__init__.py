"""Readers and writers; all paths go through Spark's file systems."""
