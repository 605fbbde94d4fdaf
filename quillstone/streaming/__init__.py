"""Incremental processing of change events."""
