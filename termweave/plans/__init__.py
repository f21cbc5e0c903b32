"""Whole runs: index build, bulk mapping, look-up."""

from .build import build_index, profiles_of
from .mapping import Options, Result, look_up, map_terms, run_bulk

__all__ = ["Options", "Result", "build_index", "look_up", "map_terms", "profiles_of", "run_bulk"]
