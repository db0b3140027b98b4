"""Readers, writers and file-name parsing."""
