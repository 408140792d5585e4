"""Readers and writers of text formats, and deterministic tables derived from the test data."""
