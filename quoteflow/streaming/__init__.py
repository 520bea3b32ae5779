"""Structured Streaming forms of the moving parts."""
