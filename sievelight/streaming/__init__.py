"""Incremental scans of file streams."""
