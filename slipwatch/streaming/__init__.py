"""Incremental load of monthly files."""
