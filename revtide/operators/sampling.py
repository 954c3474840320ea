"""Samples (template, page_id, tag_date) against histories: cuts, editors, talk pages, snapshots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revtide.functions import clock
from revtide.plans.runs import ROWS_PER_SLICE, running
from revtide.schemas import SAMPLE_KEY


def only_pages(revisions: DataFrame, samples: DataFrame) -> DataFrame:
    """Revisions of pages that have a sample; the key side is deduplicated before the semi join."""
    return revisions.join(samples.select("page_id").distinct(), "page_id", "left_semi")


def asof_cut(samples: DataFrame, revisions: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Every sample with the revisions of its page up to and including the tag."""
    side = revisions.select("page_id", "event_timestamp", *columns)
    joined = samples.select(*SAMPLE_KEY).join(side, "page_id")
    return joined.filter(F.col("event_timestamp") <= F.col("tag_date"))


def asof_cut_day(samples: DataFrame, revisions: DataFrame, columns: Sequence[str]) -> DataFrame:
    """As `asof_cut`, at date granularity: the whole day of the tag is kept."""
    side = revisions.select("page_id", "event_timestamp", *columns)
    joined = samples.select(*SAMPLE_KEY).join(side, "page_id")
    return joined.filter(F.to_date("event_timestamp") <= F.to_date("tag_date"))


def trailing_cut(samples: DataFrame, revisions: DataFrame, columns: Sequence[str], period: str) -> DataFrame:
    """Revisions within `period` before the tag, both ends included."""
    side = revisions.select("page_id", "event_timestamp", *columns)
    joined = samples.select(*SAMPLE_KEY).join(side, "page_id")
    start = F.col("tag_date") - F.expr(f"INTERVAL {period}")
    return joined.filter(F.col("event_timestamp").between(start, F.col("tag_date")))


def edits_pre_tag(revisions: DataFrame) -> DataFrame:
    """Per page, rows up to and including the first row whose has_template is the page's maximum.

    A page that never carried the template yields its first row only; `has_tag` tells them apart.
    """
    place = F.struct("event_timestamp", "revision_id")
    # 0 and 1 are the only flag values, so the first tagged row (or else the first row) is the hit.
    hits = revisions.groupBy("page_id").agg(
        F.max("has_template").alias("top_flag"),
        F.min(F.when(F.col("has_template") == 1, place)).alias("first_tagged"),
        F.min(F.when(F.col("has_template").isNotNull(), place)).alias("first_row"),
    )
    hits = hits.select(
        "page_id",
        (F.col("top_flag") == 1).alias("has_tag"),
        F.coalesce("first_tagged", "first_row").alias("hit"),
    )
    return revisions.join(hits, "page_id").filter(place <= F.col("hit")).drop("hit")


def sample_editors(samples: DataFrame, revisions: DataFrame) -> DataFrame:
    """Distinct named editors of the page up to the tag, per sample.

    Each (page, user) is reduced to its first edit before samples are joined, so the join emits
    result rows only.
    """
    first_edits = (
        only_pages(revisions, samples)
        .filter(F.col("event_user_id").isNotNull())
        .groupBy("page_id", "event_user_id")
        .agg(F.min("event_timestamp").alias("first_edit"))
    )
    joined = samples.select(*SAMPLE_KEY).join(first_edits, "page_id")
    return joined.filter(F.col("first_edit") <= F.col("tag_date")).drop("first_edit")


def attach_talk_page(samples: DataFrame, mapping: DataFrame) -> DataFrame:
    """Left join of the article -> talk page mapping."""
    side = mapping.select(F.col("article_page_id").alias("page_id"), "talk_page_id")
    return samples.drop("talk_page_id").join(side, "page_id", "left")


def labels_with_talk(samples: DataFrame, mapping: DataFrame) -> DataFrame:
    """Only samples whose page has a talk page and whose own key is complete."""
    side = mapping.select(F.col("article_page_id").alias("page_id"), "talk_page_id")
    joined = samples.drop("talk_page_id").join(side, "page_id")
    return joined.dropna(subset=[*SAMPLE_KEY, "talk_page_id"])


def nearest_snapshot(
    samples: DataFrame,
    snapshots: DataFrame,
    *,
    direction: str = "forward",
    rows_per_slice: int | None = ROWS_PER_SLICE,
) -> DataFrame:
    """The talk snapshot closest to each (talk page, tag date), with its day gap.

    forward   smallest non-negative whole-day gap after the tag; ties by time, then revision
    backward  latest snapshot at or before the tag

    Marks and snapshots share one ordered run per talk page; texts are not part of it and are
    fetched by revision_id afterwards.
    """
    if direction not in ("forward", "backward"):
        raise ValueError(f"direction must be forward or backward, not {direction!r}")
    sign = -1 if direction == "forward" else 1
    marks = (
        samples.filter(F.col("talk_page_id").isNotNull())
        .select("talk_page_id", "tag_date")
        .distinct()
        .select("talk_page_id", "tag_date", (sign * clock.micros("tag_date")).alias("at"), F.lit(1).alias("is_mark"))
    )
    placed = snapshots.select(
        F.col("page_id").alias("talk_page_id"),
        (sign * clock.micros("event_timestamp")).alias("at"),
        F.lit(0).alias("is_mark"),
        (sign * F.col("revision_id")).alias("rank_id"),
        F.struct("event_timestamp", "revision_id").alias("snapshot"),
    )
    rows = placed.join(marks.select("talk_page_id").distinct(), "talk_page_id", "left_semi")
    found = running(
        rows.unionByName(marks, allowMissingColumns=True),
        ["talk_page_id"],
        ["at", "is_mark", "rank_id"],
        prior={"nearest": F.col("snapshot")},
        sizes=placed,
        rows_per_slice=rows_per_slice,
    )
    gap = clock.elapsed_days(clock.micros("nearest.event_timestamp"), clock.micros("tag_date"))
    return found.filter((F.col("is_mark") == 1) & F.col("nearest").isNotNull()).select(
        "talk_page_id",
        "tag_date",
        F.col("nearest.revision_id").alias("revision_id"),
        F.col("nearest.event_timestamp").alias("snapshot_timestamp"),
        gap.alias("day_gap"),
    )
