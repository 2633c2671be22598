"""Typed, stratified logic programs evaluated as DataFrame plans on Apache Spark."""

from .engine import Engine, RelationHandle, evaluate
from .language.diagnostics import Diagnostic, ProgramError

__all__ = ["Diagnostic", "Engine", "ProgramError", "RelationHandle", "evaluate"]
