"""Readers of documents and records, and sinks."""
