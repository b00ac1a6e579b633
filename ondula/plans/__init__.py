"""Pipelines as data: blocks of settings, macros, and the runner."""
