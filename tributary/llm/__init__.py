"""Operators for preparing training text: formatting, filtering, deduplication, scoring and encoding."""
