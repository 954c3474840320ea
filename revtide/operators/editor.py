"""Editor features: what each editor of a sampled page had done, anywhere, by the tag date."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revtide.functions import clock
from revtide.functions.numbers import ratio, share_entropy, weight_log
from revtide.operators.sampling import sample_editors
from revtide.plans.runs import ROWS_PER_SLICE, running
from revtide.schemas import SAMPLE_KEY
from revtide.session import settle


def exclude_users(df: DataFrame, users: Sequence[int]) -> DataFrame:
    """Drop listed users; anonymous rows go too, as a NULL id compares as unknown."""
    if not users:
        return df.filter(F.col("event_user_id").isNotNull())
    return df.filter(~F.col("event_user_id").isin(*users))


def exclude_bots(df: DataFrame) -> DataFrame:
    """Keep users whose bot list is known and empty."""
    return df.filter(F.size("event_user_is_bot_by") == 0)


def array_sizes(df: DataFrame) -> DataFrame:
    """Replace group and block arrays by their sizes."""
    return df.select(
        *[c for c in df.columns if c not in ("event_user_groups", "event_user_blocks_historical", "event_user_blocks")],
        F.size("event_user_groups").alias("num_groups"),
        F.size("event_user_blocks_historical").alias("num_blocks_historical"),
        F.size("event_user_blocks").alias("num_curr_blocks"),
    )


def history_subset(history: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """Rows whose `on` occurs in `keys`."""
    return history.join(keys.select(on).distinct(), on, "left_semi")


def user_timeline(
    history: DataFrame,
    marks: DataFrame,
    columns: Sequence[str],
    total: Mapping[str, Column],
    rows_per_slice: int | None,
    prior: Mapping[str, Column] | None = None,
) -> DataFrame:
    """History rows and marks of each user in order, with running totals over marks."""
    kept = history.join(marks.select("event_user_id").distinct(), "event_user_id", "left_semi").select(
        "event_user_id", clock.micros("event_timestamp").alias("at"), F.lit(0).alias("is_mark"), "revision_id", *columns
    )
    return running(
        kept.unionByName(marks.withColumn("is_mark", F.lit(1)), allowMissingColumns=True),
        ["event_user_id"],
        ["at", "is_mark", "revision_id"],
        total=total,
        prior=prior,
        sizes=history.select("event_user_id", clock.micros("event_timestamp").alias("at")),
        rows_per_slice=rows_per_slice,
    )


def editor_state(cuts: DataFrame, history: DataFrame, *, rows_per_slice: int | None = ROWS_PER_SLICE) -> DataFrame:
    """Measures of every (event_user_id, tag_date) in `cuts` over the user's history up to the tag.

    As with pages, a user's history is read once for all their tags: revisions fall into the
    interval closed by the next tag, counts per (user, page, interval) are accumulated.
    """
    marks = cuts.select("event_user_id", "tag_date").distinct().withColumn("at", clock.micros("tag_date"))
    columns = [
        "page_id",
        "page_namespace",
        "revision_is_identity_revert",
        "revision_is_identity_reverted",
        "num_groups",
        "num_blocks_historical",
        "num_curr_blocks",
        "event_user_registration_timestamp",
    ]
    event = F.col("is_mark") == 0
    latest = ["num_groups", "num_blocks_historical", "num_curr_blocks", "event_user_registration_timestamp"]
    line = user_timeline(
        history,
        marks,
        columns,
        {"marks_seen": F.col("is_mark")},
        rows_per_slice,
        prior={"before": F.when(event, F.struct(*latest))},
    )
    per_page = line.groupBy(
        "event_user_id", "page_id", (F.col("marks_seen") - F.col("is_mark")).alias("interval")
    ).agg(
        F.count_if(event).alias("rows"),
        F.count(F.when(event, F.col("revision_id"))).alias("edits"),
        F.count_if(event & (F.col("page_namespace") == 0)).alias("articles"),
        F.count_if(event & (F.col("page_namespace") == 1)).alias("talks"),
        F.sum(F.when(event, F.col("revision_is_identity_revert").cast("long"))).alias("revert"),
        F.sum(F.when(event, F.col("revision_is_identity_reverted").cast("long"))).alias("reverted"),
        # The revision before the tag, as the mark saw it; plain columns, so the aggregate hashes.
        *[F.max(F.when(~event, F.col(f"before.{c}"))).alias(c) for c in latest],
        F.max("tag_date").alias("tag_date"),
    )
    of_page = Window.partitionBy("event_user_id", "page_id").orderBy("interval")
    held = F.sum("rows").over(of_page.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    per_page = per_page.withColumn("held", held).withColumn("had", F.col("held") - F.col("rows"))
    on_page = F.col("page_id").isNotNull() & (F.col("rows") > 0)
    sums = ["rows", "edits", "articles", "talks", "revert", "reverted"]
    per_interval = per_page.groupBy("event_user_id", "interval").agg(
        *[F.sum(c).alias(c) for c in sums],
        F.count_if(on_page & (F.col("had") == 0)).alias("pages"),
        F.sum(F.when(on_page, weight_log(F.col("held")) - weight_log(F.col("had")))).alias("weighted"),
        *[F.max(c).alias(c) for c in latest],
        F.max("tag_date").alias("tag_date"),
    )
    over_user = (
        Window.partitionBy("event_user_id")
        .orderBy("interval")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return per_interval.select(
        "event_user_id",
        "tag_date",
        *[F.sum(c).over(over_user).alias(c) for c in [*sums, "pages"]],
        F.coalesce(F.sum("weighted").over(over_user), F.lit(0.0)).alias("weighted"),
        *latest,
    ).filter(F.col("tag_date").isNotNull() & (F.col("rows") > 0))


def editor_features(
    samples: DataFrame,
    revisions: DataFrame,
    history: DataFrame,
    *,
    rows_per_slice: int | None = ROWS_PER_SLICE,
) -> DataFrame:
    """Ten features per (sample, editor of the page by the tag).

    The list of editors is written once: it marks the histories, filters them and receives the
    result, and its known file size decides whether the filter is broadcast.

    `num_reverts_by_others` sums is_revert and `num_reverts_of_others` sums is_reverted: the
    established column names, although they read swapped.
    """
    editors = settle(sample_editors(samples, revisions))
    state = editor_state(editors, history, rows_per_slice=rows_per_slice)
    features = state.select(
        "event_user_id",
        "tag_date",
        F.col("num_groups").alias("num_groups"),
        F.col("pages").alias("num_articles"),
        F.col("edits").alias("num_edits"),
        F.col("num_blocks_historical").alias("num_past_blocks"),
        F.col("num_curr_blocks"),
        F.col("revert").alias("num_reverts_by_others"),
        F.col("reverted").alias("num_reverts_of_others"),
        F.datediff("tag_date", "event_user_registration_timestamp").alias("time_since_registration"),
        ratio(F.col("articles") + 1, F.col("talks") + 1).alias("talk_article_ratio"),
        share_entropy(F.col("rows"), F.col("weighted")).alias("contribution_frac_entropy"),
    )
    return editors.join(features, ["event_user_id", "tag_date"]).select(
        *SAMPLE_KEY, "event_user_id", *[c for c in features.columns if c not in ("event_user_id", "tag_date")]
    )


def talk_article_ratio(history: DataFrame, by: Sequence[str]) -> DataFrame:
    """(article edits + 1) / (talk edits + 1) per group."""
    articles, talks = F.count_if(F.col("page_namespace") == 0), F.count_if(F.col("page_namespace") == 1)
    return history.groupBy(*by).agg(ratio(articles + 1, talks + 1).alias("talk_article_ratio"))


def editor_page_entropy(history: DataFrame, by: Sequence[str]) -> DataFrame:
    """Entropy of a group's edit shares over pages, counted per page first."""
    per_page = history.groupBy(*by, "page_id").agg(F.count(F.lit(1)).alias("held"))
    total, weighted = F.sum("held"), F.sum(weight_log(F.col("held")))
    return per_page.groupBy(*by).agg(share_entropy(total, weighted).alias("contribution_frac_entropy"))
