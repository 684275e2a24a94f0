"""Every query of the library's own operators."""

from __future__ import annotations

import importlib

from framesift.plans.registry import ORACLES, QUERIES

GROUPS = ("sampling_queries", "classify_queries", "person_queries", "frame_queries", "selection_queries", "table_queries", "stream_queries")
#: query -> the module that has it
WHERE: dict[str, str] = {}
for group in GROUPS:
    importlib.import_module(f"framesift.plans.{group}")
    WHERE |= {name: group for name in QUERIES if name not in WHERE}

__all__ = ["ORACLES", "QUERIES", "WHERE"]
