"""Cutting lineage through the folder that the driver and all executors share, as the rest of the library does."""

from __future__ import annotations

from veridex.sources.shared import folder, written

__all__ = ["folder", "written"]
