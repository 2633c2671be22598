"""Scalar functions of the language as Column expressions.

Numbers are signed integers of 32 (or 64) bits held as ``bigint`` while computing; results of 32-bit arithmetic wrap
around, whatever the session says about overflow.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def number_type(bits: int) -> str:
    return "int" if bits == 32 else "bigint"


def wrap(x: Column, bits: int) -> Column:
    if bits == 64:
        return x
    return F.shiftright(F.shiftleft(x, 32), 32).cast("int")


def arithmetic(op: str, a: Column, b: Column, bits: int) -> Column:
    x, y = a.cast("bigint"), b.cast("bigint")
    if op == "+":
        r = x + y
    elif op == "-":
        r = x - y
    elif op == "*":
        r = x * y
    elif op == "/":
        r = _div(x, y)
    elif op == "%":
        r = x % y
    else:
        r = F.pow(x.cast("double"), y.cast("double")).cast("bigint")
    return wrap(r, bits)


def _div(x: Column, y: Column) -> Column:
    """Integer division towards zero that stays exact beyond 2**53."""
    quotient = (x - x % y) / y
    small = F.abs(x) <= F.lit(1 << 52)
    exact = ((x - x % y).cast("decimal(38,0)") / y.cast("decimal(38,0)")).cast("bigint")
    return F.when(small, quotient.cast("bigint")).otherwise(exact)


def negate(a: Column, bits: int) -> Column:
    return wrap(-a.cast("bigint"), bits)


def fold(op: str, args: list[int], bits: int) -> int:
    """The same arithmetic on constants."""
    x, y = (args + [0])[:2]
    if op == "neg":
        r = -x
    elif op == "+":
        r = x + y
    elif op == "-":
        r = x - y
    elif op == "*":
        r = x * y
    elif op in "/%":
        q = abs(x) // abs(y) * (1 if (x < 0) == (y < 0) else -1)
        r = q if op == "/" else x - q * y
    else:
        r = int(float(x) ** float(y))
    half = 1 << (bits - 1)
    return (r + half) % (2 * half) - half


def valid_pattern(spark: SparkSession, pattern: str) -> bool:
    try:
        spark._jvm.java.util.regex.Pattern.compile(pattern)
        return True
    except Exception:
        return False


def match_literal(pattern: str, text: Column) -> Column:
    return text.rlike(rf"\A(?:{pattern})\z")


def _match_each(patterns: pd.Series, texts: pd.Series) -> pd.Series:
    compiled: dict[str, re.Pattern | None] = {}
    out = []
    for p, t in zip(patterns, texts):
        if p not in compiled:
            try:
                compiled[p] = re.compile(p)
            except re.error:
                compiled[p] = None  # an invalid pattern matches nothing
        out.append(compiled[p] is not None and compiled[p].fullmatch(t) is not None)
    return pd.Series(out, dtype=bool)


def match_column(pattern: Column, text: Column) -> Column:
    """Patterns from data: compiled once per batch, invalid ones match nothing (Spark would stop the job)."""
    return F.pandas_udf(_match_each, "boolean")(pattern, text)
