"""Money arithmetic.

Amounts are doubles at the edges and ``decimal(18,2)`` inside: summing or
rounding doubles depends on evaluation order, decimals do not.  Results are
cast back to double last.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"


def money(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c.cast(MONEY)


def rate(x: float) -> Column:
    """A percentage rate as an exact decimal literal (0.05 -> decimal(4,2))."""
    return F.lit(str(x)).cast("decimal(4,2)")


def sum_money(c: Column | str) -> Column:
    """NULL-safe exact sum of a money column (0 on empty), decimal."""
    return F.coalesce(F.sum(money(c)), F.lit(0).cast(MONEY))


def to_double(c: Column) -> Column:
    return c.cast("double")


def js_round(c: Column) -> Column:
    """``Math.round``: floor(x + 0.5)."""
    return F.floor(c + F.lit(0.5))
