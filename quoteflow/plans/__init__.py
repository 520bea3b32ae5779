"""Registered queries with their check SQL, over the test tables."""
