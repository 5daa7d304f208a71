"""Scans as a stream of files."""
