"""Stored tables of the library: versions, indexes and sinks."""
