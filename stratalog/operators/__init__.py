"""Relational operators of their own, for DataFrames at hand."""

from .graph import connected, same_generation, transitive_closure

__all__ = ["connected", "same_generation", "transitive_closure"]
