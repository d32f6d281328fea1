"""Structured Streaming over event tables; an extension, as the reference has no streams."""
