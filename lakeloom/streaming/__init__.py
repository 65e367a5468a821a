"""Structured Streaming forms of the event queries: an extension, the engine this follows has no streams."""
