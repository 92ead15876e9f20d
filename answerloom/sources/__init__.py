"""Readers and writers for answer tables, task files, grades and metrics."""
