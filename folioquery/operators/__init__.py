"""Relational operators over record frames."""
