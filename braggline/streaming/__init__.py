"""Structured Streaming forms of the operators for data still arriving."""
