"""Readers and writers of landed files and tables."""
