"""Cycle-level analytics of sampled recordings as lazy Spark plans."""

__version__ = "0.1.0"
