"""Structured Streaming forms of scoring and run following."""
