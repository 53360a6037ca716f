"""Incremental forms of batch work."""
