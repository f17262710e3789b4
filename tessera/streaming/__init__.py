"""Structured Streaming forms of index synchronisation and metrics."""
