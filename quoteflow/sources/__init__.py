"""Readers, writers and file level jobs."""
