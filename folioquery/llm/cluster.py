"""What operators share: where lineage is cut, and what counts as white space."""

from __future__ import annotations

from folioquery.storage import discard, materialise, shared_dir

__all__ = ["ASCII_SPACE", "discard", "materialise", "shared_dir"]

#: ASCII white space: what every operator of this package strips and splits on.
ASCII_SPACE = " \t\n\x0b\x0c\r"
