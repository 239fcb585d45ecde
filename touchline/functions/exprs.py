"""Column helpers that carry the null rules of the source definitions.

Two rules matter: a plain sum or max is *strict* (one NULL makes the whole
result NULL), and a two-way choice on an unknown condition is unknown, while a
multi-way choice falls through.  Spark's own ``sum``/``max``/``when`` are
lenient, so the strict forms are spelled out here once.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def one_of(col: Column, values: Iterable[str]) -> Column:
    """Membership test that is false, not NULL, for a NULL input."""
    return F.coalesce(col.isin(list(values)), F.lit(False))


def sure(cond: Column) -> Column:
    """Condition with unknown read as false."""
    return F.coalesce(cond, F.lit(False))


def flag(cond: Column) -> Column:
    """1/0, unknown counts as 0."""
    return F.when(cond, 1).otherwise(0)


def open_flag(cond: Column) -> Column:
    """1/0, unknown stays NULL."""
    return F.when(cond, 1).when(~cond, 0)


def choose(cond: Column, value: Column, other: Column) -> Column:
    """Two-way choice that is NULL when the condition is unknown."""
    return F.when(cond, value).when(~cond, other)


def strict_sum(col: Column) -> Column:
    return F.when(F.count(col) == F.count(F.lit(1)), F.sum(col))


def strict_max(col: Column) -> Column:
    return F.when(F.count(col) == F.count(F.lit(1)), F.max(col))


def ratio(top: Column, bottom: Column) -> Column:
    """Division that is NULL, not an error, for a zero denominator."""
    return F.try_divide(top.cast("double"), bottom.cast("double"))
