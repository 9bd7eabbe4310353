"""Naming an intermediate value inside a column expression."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def once(value: Column, body) -> Column:
    """``body(value)`` with ``value`` written and computed once, however often ``body`` uses it."""
    return F.transform(F.array(value), body)[0]


def inside(name: str) -> str:
    """Pattern: what stands before the next tag of this name, start or end. So a start tag without an end costs a look at the next one, not at the whole page."""
    return rf"(?:(?!</?(?:{name})\b).)*+"
