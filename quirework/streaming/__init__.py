"""Incremental operation on streams."""
