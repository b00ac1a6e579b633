"""Readers of recordings, and writers of results."""
