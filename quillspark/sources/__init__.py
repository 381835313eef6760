"""Readers and writers of external formats."""
