"""Room for an operator's own columns beside a caller's, whatever theirs are called."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def aside(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The same rows with columns called c0, c1, ... and what each of the caller's names became."""
    names = [f"c{i}" for i in range(len(df.columns))]
    return df.toDF(*names), dict(zip(df.columns, names))


def restore(df: DataFrame, columns: list[str], *more: str) -> DataFrame:
    """The caller's names again, and columns that were added under their own."""
    return df.select(*[F.col(f"c{i}").alias(name) for i, name in enumerate(columns)], *more)
