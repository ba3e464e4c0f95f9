"""Exact integer arithmetic on id columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def idiv(column: str, n: int) -> Column:
    """``column div n``: exact integer division (``/`` would go through a
    double and lose precision past 2**53)."""
    return F.expr(f"`{column}` div {int(n)}")
