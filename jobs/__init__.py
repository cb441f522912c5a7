"""Runnable jobs over a store's tables. Each has a function that takes a session, and a command line with a small config file."""
