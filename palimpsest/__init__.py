"""Conversation-memory analytics on Spark: rounds, indexes over them, ranked retrieval and its evaluation."""
