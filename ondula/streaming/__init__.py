"""Cycles of live recordings."""
