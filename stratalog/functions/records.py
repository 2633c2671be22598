"""Records as one canonical string: ``~`` for nil, else ``[`` and each field as length, colon and text.

Equal records are equal strings on every executor, so joins and distinct need nothing special, and recursive records
(lists, trees) need no recursive schema. Fields are taken apart by their lengths, in Column expressions only.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NIL = "~"


def pack(fields: list[Column]) -> Column:
    parts = [F.lit("[")]
    for f in fields:
        s = f.cast("string")
        parts += [F.length(s).cast("string"), F.lit(":"), s]
    return F.concat(*parts)


def pack_value(fields: list) -> str:
    return "[" + "".join(f"{len(str(f))}:{f}" for f in fields)


def rest(record: Column) -> Column:
    """What follows the opening sign."""
    return F.substring(record, 2, 2**31 - 1)


def first_field(tail: Column) -> Column:
    size = F.substring_index(tail, ":", 1)
    return F.substring(tail, F.length(size) + 2, size.try_cast("int"))


def after_first(tail: Column) -> Column:
    size = F.substring_index(tail, ":", 1)
    return F.substring(tail, F.length(size) + 2 + size.try_cast("int"), F.lit(2**31 - 1))


def unpack_value(s: str) -> list[str] | None:
    """The field texts of an encoded record; None for nil."""
    if s == NIL:
        return None
    out, at = [], 1
    while at < len(s):
        colon = s.index(":", at)
        n = int(s[at:colon])
        out.append(s[colon + 1 : colon + 1 + n])
        at = colon + 1 + n
    return out
