"""Operators for preparing training text, and their queries."""
