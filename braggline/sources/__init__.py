"""Scans, schemas and sinks."""
