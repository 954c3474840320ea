"""Ordered running values per key that stay balanced when one key holds a large share of all rows.

A plain window puts a whole key into one task. Here a key with more than about LARGE * `rows_per_slice`
rows is cut along its order into slices of about `rows_per_slice` *rows* each; the window runs per
(key, slice), and what crosses a slice border (last value, next value, running sum, running maximum)
is carried over from a table with one row per slice. Rows of one key at one and the same position
cannot be told apart by it and share a slice.

Where to cut is read from a sample of (key, position), SAMPLES rows per slice on average, as a range
shuffle does; bursts and early rows do not matter. The sample decides on balance only: results are the same
wherever the cuts fall. The cuts are written once, so all parts of a plan see the same ones, and counted:
up to MAX_BROADCAST of them are broadcast, more are joined as any other table.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revtide.session import settle

ROWS_PER_SLICE = 500_000
LARGE = 4
SAMPLES = 64
MAX_BROADCAST = 500_000
SALTS = 16


def slice_cuts(df: DataFrame, keys: Sequence[str], position: str, rows_per_slice: int) -> DataFrame:
    """(keys, _heads, _blocks, _width): the first positions of the slices of each large key.

    They are kept in blocks of `_width`, the root of their number, with the head of each block apart, so
    that finding a row's slice looks at two short lists.
    """
    step = min(SAMPLES, rows_per_slice)
    drawn = df.select(*keys, F.col(position).alias("_at")).filter(F.col("_at").isNotNull())
    if step < rows_per_slice:
        drawn = drawn.filter(F.rand(17) < step / rows_per_slice)
    whole = Window.partitionBy(*keys)
    ranked = drawn.select(
        *keys, "_at", F.row_number().over(whole.orderBy("_at")).alias("_rank"), F.count(F.lit(1)).over(whole).alias("_drawn")
    )
    chosen = ranked.filter((F.col("_drawn") > LARGE * step) & (F.col("_rank") % step == 0))
    # A list holds the key's rows / rows_per_slice positions.
    cuts = chosen.groupBy(*keys).agg(F.array_sort(F.collect_set("_at")).alias("_cuts"))
    width = F.ceil(F.sqrt(F.size("_cuts"))).cast("int")
    firsts = F.sequence(F.lit(1), F.size("_cuts"), width)
    return cuts.select(
        *keys,
        F.transform(firsts, lambda i: F.element_at("_cuts", i)).alias("_heads"),
        F.transform(firsts, lambda i: F.slice("_cuts", i, width)).alias("_blocks"),
        width.alias("_width"),
    )


def slice_of(position: str) -> Column:
    """How many cuts lie at or before the position: 0 for ordinary keys and for NULL positions."""

    def upto(values: Column) -> Column:
        return F.size(F.filter(values, lambda cut: cut <= F.col(position)))

    block = upto(F.col("_heads"))
    found = (block - 1) * F.col("_width") + upto(F.element_at("_blocks", F.greatest(block, F.lit(1))))
    return F.when(F.col("_heads").isNull() | (block == 0), F.lit(0)).otherwise(found)


def _join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str, small: bool) -> DataFrame:
    """Join in which NULL keys meet each other; `right` is broadcast where it is known to be small."""
    renamed = right.withColumnsRenamed({name: f"_right_{name}" for name in on})
    same = functools.reduce(operator.and_, [F.col(name).eqNullSafe(F.col(f"_right_{name}")) for name in on])
    return left.join(F.broadcast(renamed) if small else renamed, same, how).drop(*[f"_right_{name}" for name in on])


def lookup(df: DataFrame, table: DataFrame, on: Sequence[str], deal: str, small: bool) -> DataFrame:
    """Inner join with a table that has one or few rows per key, broadcast where `small`, as counted.

    Otherwise the rows of a key are dealt by the column `deal` over SALTS copies of its entry, as one key may
    hold a third of all rows.
    """
    if small:
        return df.join(F.broadcast(table), list(on))
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(deal), F.lit(SALTS)))
    salts = F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))
    return salted.join(table.withColumn("_salt", F.explode(salts)), [*on, "_salt"]).drop("_salt")


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    *,
    prior: Mapping[str, Column] | None = None,
    following: Mapping[str, Column] | None = None,
    total: Mapping[str, Column] | None = None,
    peak: Mapping[str, Column] | None = None,
    sizes: DataFrame | None = None,
    rows_per_slice: int | None = ROWS_PER_SLICE,
) -> DataFrame:
    """Add running columns to `df`.

    prior      last non-null value strictly before the row
    following  value of the next row (wrap it in a struct if it may be null)
    total      sum up to and including the row
    peak       maximum up to and including the row

    `order` holds numeric columns, ascending; the first one is the position slices are cut on.
    `sizes` is a cheaper frame with the keys and the position to draw the sample from, such as the plain
    scan below a `df` that joins or unions more onto it.
    Rows with a NULL key form a key of their own, sliced like any other.
    `rows_per_slice=None` skips slicing, for keys whose size is bounded anyway.
    """
    prior, following = dict(prior or {}), dict(following or {})
    total, peak = dict(total or {}), dict(peak or {})
    wanted = {**prior, **following, **total, **peak}
    staged = df.select("*", *[value.alias(f"_in_{name}") for name, value in wanted.items()])
    source = {name: F.col(f"_in_{name}") for name in wanted}

    group = list(keys)
    if rows_per_slice is not None:
        cuts = settle(slice_cuts(df if sizes is None else sizes, keys, order[0], rows_per_slice))
        sliced = cuts.agg(F.coalesce(F.sum(F.size("_heads") * F.col("_width")), F.lit(0))).first()[0]
        small = sliced <= MAX_BROADCAST
        group = [*keys, "_slice"]

        def slice_rows(how: str) -> DataFrame:
            joined = _join(staged, cuts, keys, how, small)
            return joined.withColumn("_slice", slice_of(order[0])).drop("_heads", "_blocks", "_width")

        # Rows may arrive hashed by the keys alone, which would satisfy the window and keep a hot key whole.
        rows = slice_rows("left").repartition(*group)
    else:
        rows = staged

    ordered = Window.partitionBy(*group).orderBy(*order)
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    so_far = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = rows.select(
        *df.columns,
        *([] if rows_per_slice is None else ["_slice"]),
        *[F.last(source[n], ignorenulls=True).over(before).alias(n) for n in prior],
        *[F.lead(source[n]).over(ordered).alias(n) for n in following],
        *[F.sum(source[n]).over(so_far).alias(n) for n in total],
        *[F.max(source[n]).over(so_far).alias(n) for n in peak],
    )
    if rows_per_slice is None:
        return local
    if sliced == 0:  # nothing crosses a border
        return local.drop("_slice")

    place = F.struct(*order)
    edges = (
        slice_rows("inner")
        .groupBy(*group)
        .agg(
            F.count(F.lit(1)).alias("_rows"),
            *[F.max_by(source[n], F.when(source[n].isNotNull(), place)).alias(f"_edge_{n}") for n in prior],
            *[F.min_by(source[n], place).alias(f"_edge_{n}") for n in following],
            *[F.sum(source[n]).alias(f"_edge_{n}") for n in total],
            *[F.max(source[n]).alias(f"_edge_{n}") for n in peak],
        )
    )
    by_slice = Window.partitionBy(*keys).orderBy("_slice")
    earlier = by_slice.rowsBetween(Window.unboundedPreceding, -1)
    carried = edges.select(
        *group,
        *[F.last(f"_edge_{n}", ignorenulls=True).over(earlier).alias(f"_carry_{n}") for n in prior],
        *[F.lead(f"_edge_{n}").over(by_slice).alias(f"_carry_{n}") for n in following],
        *[F.sum(f"_edge_{n}").over(earlier).alias(f"_carry_{n}") for n in total],
        *[F.max(f"_edge_{n}").over(earlier).alias(f"_carry_{n}") for n in peak],
    )
    joined = _join(local, carried, group, "left", small)

    def carry(name: str) -> Column:
        return F.col(f"_carry_{name}")

    return joined.select(
        *df.columns,
        *[F.coalesce(F.col(n), carry(n)).alias(n) for n in [*prior, *following]],
        *[F.when(carry(n).isNull(), F.col(n)).otherwise(F.coalesce(F.col(n), F.lit(0)) + carry(n)).alias(n) for n in total],
        *[F.greatest(F.col(n), carry(n)).alias(n) for n in peak],
    )
