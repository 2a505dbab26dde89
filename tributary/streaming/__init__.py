"""Structured Streaming jobs: landing feeds, draining change logs, event rates."""
