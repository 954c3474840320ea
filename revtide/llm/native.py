"""Column helpers for the operators that stay inside Spark's own functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = " \t\n\x0b\x0c\r"
BLANK_RUN = r"[ \t\n\x0B\f\r]+"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with `value` worked out once per row, however often `use` refers to it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def words(text: Column) -> Column:
    """Runs of characters other than ASCII white space."""
    return F.array_remove(F.split(text, BLANK_RUN), "")


def upto(n: Column) -> Column:
    """0 .. n-1, empty where n <= 0."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
