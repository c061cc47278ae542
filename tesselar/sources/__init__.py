"""Readers and writers of the logical tables."""
