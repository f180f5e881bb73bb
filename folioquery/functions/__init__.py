"""Scalar function libraries of the three dialects; importing this registers them."""

from folioquery.functions import arrays, dates, files, maths, text  # noqa: F401
