"""Time series of one page: row-to-row metrics, daily activity, template transitions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revtide.functions import clock
from revtide.plans.runs import ROWS_PER_SLICE, running
from revtide.session import settle

DAYS_PER_RANGE = 366


def edit_size(size: Column, previous: Column) -> Column:
    """Absolute change in bytes; the plain size where there is nothing to compare with."""
    return F.abs(F.coalesce(size - previous, size))


def page_metrics(revisions: DataFrame, *, rows_per_slice: int | None = ROWS_PER_SLICE) -> DataFrame:
    """Add time_to_respond, time_responded_to, edit_size and next_edit_size to every revision of a page.

    Revisions without a page belong to none and are left out.
    """
    placed = revisions.filter(F.col("page_id").isNotNull()).withColumn("at", clock.micros("event_timestamp"))
    here = F.struct(F.col("at"), F.col("revision_text_bytes").alias("bytes"))
    linked = running(
        placed,
        ["page_id"],
        ["at", "revision_id"],
        prior={"before": here},
        following={"after": here},
        rows_per_slice=rows_per_slice,
    )
    size = F.col("revision_text_bytes")
    return linked.select(
        *revisions.columns,
        clock.elapsed_hours(F.col("at"), F.col("before.at")).alias("time_to_respond"),
        clock.elapsed_hours(F.col("after.at"), F.col("at")).alias("time_responded_to"),
        edit_size(size, F.col("before.bytes")).alias("edit_size"),
        F.when(F.col("after").isNull(), F.lit(0))
        .otherwise(F.abs(F.col("after.bytes") - size))
        .alias("next_edit_size"),
    )


def edit_sizes(revisions: DataFrame, *, rows_per_slice: int | None = ROWS_PER_SLICE) -> DataFrame:
    """page_id, at, edit_size and start_at, the page's first revision: what daily activity needs."""
    placed = revisions.filter(F.col("page_id").isNotNull()).select(
        "page_id", clock.micros("event_timestamp").alias("at"), "revision_id", "revision_text_bytes"
    )
    linked = running(
        placed,
        ["page_id"],
        ["at", "revision_id"],
        prior={"before": F.struct("revision_text_bytes")},
        peak={"ago": -F.col("at")},
        rows_per_slice=rows_per_slice,
    )
    size = edit_size(F.col("revision_text_bytes"), F.col("before.revision_text_bytes"))
    return linked.select("page_id", "at", size.alias("edit_size"), (-F.col("ago")).alias("start_at"))


def active_days(sizes: DataFrame, keys: Sequence[str] = ("page_id",), **more: Column) -> DataFrame:
    """Edits, edited volume and `more` aggregates per page and day since `start_at`.

    Rows come dealt by slices of a page, so they are summed per day before they are shuffled.
    """
    return sizes.groupBy(*keys, clock.elapsed_days(F.col("at"), F.col("start_at")).alias("days_since_start")).agg(
        F.count(F.lit(1)).alias("daily_edit_count"),
        F.sum(F.abs("edit_size")).alias("daily_edit_vol"),
        *[value.alias(name) for name, value in more.items()],
    )


def fill_days(active: DataFrame, keys: Sequence[str] = ("page_id",)) -> DataFrame:
    """Empty days between the first and the last active day of a page, as 0. At most one row per calendar day."""
    gap_filled = Window.partitionBy(*keys).orderBy("days_since_start")
    next_day = F.coalesce(F.lead("days_since_start").over(gap_filled), F.col("days_since_start") + 1)
    # A day row followed by a gap also emits the empty days of the gap.
    spread = active.withColumn("until", next_day).select(
        *keys,
        F.col("days_since_start").alias("active_day"),
        "daily_edit_count",
        "daily_edit_vol",
        F.explode(F.sequence("days_since_start", F.col("until") - 1)).alias("days_since_start"),
    )
    empty = F.col("days_since_start") != F.col("active_day")
    return spread.select(
        *keys,
        "days_since_start",
        F.when(empty, 0).otherwise(F.col("daily_edit_count")).alias("daily_edit_count"),
        F.when(empty, 0).otherwise(F.coalesce("daily_edit_vol", F.lit(0))).alias("daily_edit_vol"),
    )


def daily_activity(sizes: DataFrame) -> DataFrame:
    """Edits and edited volume per page and day since the page's start, with empty days as 0."""
    return fill_days(active_days(sizes))


def page_starts(revisions: DataFrame) -> DataFrame:
    return revisions.groupBy("page_id").agg(F.min(clock.micros("event_timestamp")).alias("start_at"))


def rolling_mean(
    daily: DataFrame, column: str, window: int, name: str, keys: Sequence[str] = ("page_id",), *, days_per_range: int = DAYS_PER_RANGE
) -> DataFrame:
    """Mean over the last `window` days, 0 until that many days exist.

    Days are dealt by ranges of (page, day); the last `window - 1` days of a range are copied to the ranges that
    look back at them (a halo), so no task needs a whole page. `daily` has every day of a page.
    """
    own = F.floor(F.col("days_since_start") / days_per_range)
    until = F.floor((F.col("days_since_start") + (window - 1)) / days_per_range)
    dealt = daily.withColumn("_own", own).withColumn("_range", F.explode(F.sequence(own, until)))
    # Ranges of a page must not meet again because the days came hashed by page.
    dealt = dealt.repartition(*keys, "_range")
    by_day = Window.partitionBy(*keys, "_range").orderBy("days_since_start")
    frame = by_day.rowsBetween(-(window - 1), 0)
    full = F.count(F.lit(1)).over(frame) == window
    smooth = dealt.withColumn(name, F.when(full, F.avg(column).over(frame)).otherwise(F.lit(0.0)))
    return smooth.filter(F.col("_own") == F.col("_range")).drop("_own", "_range")


def template_transitions(
    revisions: DataFrame, starts: DataFrame, *, rows_per_slice: int | None = ROWS_PER_SLICE
) -> DataFrame:
    """Revisions at which the template appears or disappears, with their day since the start."""
    placed = revisions.select(
        "page_id", clock.micros("event_timestamp").alias("at"), "revision_id", "event_timestamp", "has_template"
    )
    linked = running(
        placed,
        ["page_id"],
        ["at", "revision_id"],
        prior={"before": F.struct("has_template")},
        rows_per_slice=rows_per_slice,
    )
    change = F.col("has_template") - F.col("before.has_template")
    moved = linked.withColumn("change", change).filter(F.col("change").isin(1, -1))
    return moved.join(starts, "page_id").select(
        "page_id",
        "revision_id",
        "event_timestamp",
        clock.elapsed_days(F.col("at"), F.col("start_at")).alias("days_since_start"),
        F.when(F.col("change") == 1, "added").otherwise("removed").alias("transition"),
    )


def talk_vs_article_activity(
    revisions: DataFrame,
    mapping: DataFrame,
    *,
    column: str = "daily_edit_vol",
    window: int = 60,
    rows_per_slice: int | None = ROWS_PER_SLICE,
) -> DataFrame:
    """Smoothed daily activity of an article and of its talk page on the article's day count.

    One row per (article, side, day) with the smoothed value, its log volume, and whether the
    template was added or removed on the article that day. The history is read twice: for the starts of
    pages, and for one run that gives sizes and template changes alike.
    """
    starts = page_starts(revisions).withColumnRenamed("page_id", "article_page_id")
    side = F.inline(
        F.array(
            F.struct(F.col("article_page_id").alias("page_id"), F.lit("article").alias("side")),
            F.struct(F.col("talk_page_id").alias("page_id"), F.lit("talk").alias("side")),
        )
    )
    sides = settle(mapping.join(starts, "article_page_id").select("article_page_id", "start_at", side).distinct())
    keys = ["article_page_id", "side"]
    rows = settle(
        revisions.select(
            "page_id", clock.micros("event_timestamp").alias("at"), "revision_id", F.col("revision_text_bytes").alias("bytes"), "has_template"
        ).join(sides, "page_id")
    )
    linked = running(
        rows, keys, ["at", "revision_id"], prior={"before": F.struct("bytes", "has_template")}, rows_per_slice=rows_per_slice
    )
    change = F.when(F.col("side") == "article", F.col("has_template") - F.col("before.has_template"))
    sizes = linked.withColumn("edit_size", edit_size(F.col("bytes"), F.col("before.bytes"))).withColumn("change", change)
    days = settle(
        active_days(
            sizes,
            keys,
            template_added=F.max((F.col("change") == 1).cast("int")),
            template_removed=F.max((F.col("change") == -1).cast("int")),
        )
    )
    smooth = rolling_mean(fill_days(days, keys), column, window, "smoothed", keys)
    flagged = (F.col("template_added") == 1) | (F.col("template_removed") == 1)
    events = days.filter(flagged).select("article_page_id", "days_since_start", "template_added", "template_removed")
    return smooth.join(events, ["article_page_id", "days_since_start"], "left").select(
        "article_page_id",
        "side",
        "days_since_start",
        "smoothed",
        F.log1p("smoothed").alias("log_smoothed"),
        F.coalesce("template_added", F.lit(0)).alias("template_added"),
        F.coalesce("template_removed", F.lit(0)).alias("template_removed"),
    )
