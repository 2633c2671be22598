"""Programs over streams of facts."""

from .monotone import MonotoneProgram

__all__ = ["MonotoneProgram"]
