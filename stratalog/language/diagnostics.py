"""Errors and warnings with their place in the source."""

from __future__ import annotations

from dataclasses import dataclass

from .ast import NOWHERE, Pos


@dataclass(frozen=True)
class Diagnostic:
    severity: str
    message: str
    pos: Pos = NOWHERE

    def show(self, sources: dict[str, list[str]] | None = None) -> str:
        out = f"{self.severity}: {self.message} in file {self.pos.file} at line {self.pos.line}"
        lines = (sources or {}).get(self.pos.file, [])
        if 0 < self.pos.line <= len(lines):
            line = lines[self.pos.line - 1]
            out += f"\n{line}\n{'-' * max(0, self.pos.col - 1)}^{'-' * max(0, len(line) - self.pos.col)}"
        return out


class ProgramError(Exception):
    """A program that can't be evaluated; ``diagnostics`` says why."""

    def __init__(self, diagnostics: list[Diagnostic], sources: dict[str, list[str]] | None = None):
        self.diagnostics = diagnostics
        n = sum(d.severity == "Error" for d in diagnostics)
        super().__init__("\n".join([*(d.show(sources) for d in diagnostics), f"{n} errors generated, evaluation aborted"]))
