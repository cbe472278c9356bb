"""Structured Streaming forms of the study's logs."""
