"""Incremental preparation with Structured Streaming."""
