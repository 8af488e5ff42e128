"""Streaming forms of the activity figures and of watch-list ingest."""
