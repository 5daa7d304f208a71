"""Readers and writers of scans, frames and reports."""
