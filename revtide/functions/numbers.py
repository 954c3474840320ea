"""Ratios and entropies with their empty cases spelled out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(part: Column, whole: Column) -> Column:
    """part / whole as a double, NULL when whole is 0 or NULL."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def weight_log(count: Column) -> Column:
    """c * log2(c), 0 for an empty group: the building block of a share entropy."""
    return F.when(count > 0, count * F.log2(count.cast("double"))).otherwise(F.lit(0.0))


def share_entropy(total: Column, weighted: Column) -> Column:
    """Entropy in bits of the shares c/total, given sum(c*log2(c)); 0 when nothing was counted."""
    positive = F.greatest(F.log2(total.cast("double")) - weighted / total, F.lit(0.0))
    return F.when(total > 0, positive).otherwise(F.lit(0.0))


def entropy_term(share: Column) -> Column:
    return F.when(share > 0, -share * F.log2(share)).otherwise(F.lit(0.0))


def known(value: Column) -> Column:
    """NaN to NULL, so that averages and correlations skip it."""
    return F.when(F.isnan(value.cast("double")), F.lit(None)).otherwise(value.cast("double"))


def round_doubles(df, digits: int = 6):
    """Round every double column, for stable comparison and export."""
    return df.select(
        *[
            (F.round(F.col(f"`{n}`"), digits)).alias(n) if t == "double" else F.col(f"`{n}`")
            for n, t in df.dtypes
        ]
    )
