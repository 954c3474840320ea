"""Co-editing: pairs of users who edited the same page, and the ratios built on them.

Operators take `by`, the columns that separate independent histories (a sample key, or nothing).
The result has one row per pair of co-editors, so pair rows have to be produced; what is avoided is
producing them twice, producing them where only totals are needed, and producing all pairs of a
popular page in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revtide.functions import clock
from revtide.functions.numbers import ratio
from revtide.operators.editor import user_timeline
from revtide.operators.sampling import sample_editors
from revtide.plans.runs import ROWS_PER_SLICE
from revtide.schemas import SAMPLE_KEY
from revtide.session import settle

USERS_PER_BLOCK = 1_000
PAIRS_PER_TASK = 1_000_000


def page_user_counts(history: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Revisions of each named user on each page, with the namespace of the first one there.

    A page is in one namespace at a time, so equal times need no further order; a plain number to
    order by keeps the aggregate hashed.
    """
    place = clock.micros("event_timestamp")
    return history.filter(F.col("event_user_id").isNotNull()).groupBy(*by, "page_id", "event_user_id").agg(
        F.count("revision_id").alias("revisions_count"),
        F.min_by("page_namespace", place).alias("page_namespace"),
    )


def period_counts(
    samples: DataFrame,
    revisions: DataFrame,
    history: DataFrame,
    *,
    period: str = "1 YEAR",
    rows_per_slice: int | None = ROWS_PER_SLICE,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The editors of each sample, each editor's tags by rank, and their edits by page and by the tags they count for.

    Each user's history is cut once at both ends of all their periods. Periods of one user start and
    end in the order of their tags, so a revision lies in the periods of tags e+1 .. s, where s
    starts and e ends came before it: edits are counted per (user, page, s, e).
    """
    editors = settle(sample_editors(samples, revisions))
    tags = editors.select("event_user_id", "tag_date").distinct()
    start = clock.micros(F.col("tag_date") - F.expr(f"INTERVAL {period}")) - 1
    marks = tags.select(
        "event_user_id",
        F.inline(
            F.array(
                F.struct(start.alias("at"), F.lit(1).alias("starts"), F.lit(0).alias("ends")),
                F.struct(clock.micros("tag_date").alias("at"), F.lit(0).alias("starts"), F.lit(1).alias("ends")),
            )
        ),
    )
    line = user_timeline(
        history,
        marks,
        ["page_id", "page_namespace"],
        {"started": F.coalesce("starts", F.lit(0)), "ended": F.coalesce("ends", F.lit(0))},
        rows_per_slice,
    )
    counted = (
        line.filter((F.col("is_mark") == 0) & (F.col("started") > F.col("ended")))
        .groupBy("event_user_id", "page_id", "started", "ended")
        .agg(
            F.count("revision_id").alias("revisions_count"),
            F.min("at").alias("first_at"),
            F.min_by("page_namespace", "at").alias("page_namespace"),
        )
    )
    ranked = tags.withColumn(
        "tag_rank", F.row_number().over(Window.partitionBy("event_user_id").orderBy("tag_date")).cast("long")
    )
    return editors, ranked, counted


def sample_page_users(
    samples: DataFrame,
    revisions: DataFrame,
    history: DataFrame,
    *,
    period: str = "1 YEAR",
    rows_per_slice: int | None = ROWS_PER_SLICE,
) -> DataFrame:
    """`page_user_counts` per sample: its editors, over the `period` before the tag.

    Counts are spread over just the tags they belong to.
    """
    editors, ranked, counted = period_counts(samples, revisions, history, period=period, rows_per_slice=rows_per_slice)
    per_tag = (
        counted.withColumn("tag_rank", F.explode(F.sequence(F.col("ended") + 1, F.col("started"))))
        .groupBy("event_user_id", "tag_rank", "page_id")
        .agg(
            F.sum("revisions_count").alias("revisions_count"),
            F.min_by("page_namespace", "first_at").alias("page_namespace"),
        )
        .join(ranked, ["event_user_id", "tag_rank"])
    )
    return editors.join(per_tag.withColumnRenamed("page_id", "edited_page_id"), ["event_user_id", "tag_date"]).select(
        *SAMPLE_KEY,
        "edited_page_id",
        "event_user_id",
        "revisions_count",
        "page_namespace",
    )


def tasks_for_pairs(rows: DataFrame, group: Sequence[str], pairs_per_task: int) -> int:
    """How many tasks the pairs of users of all groups ask for, from the sizes of the groups.

    A few bytes of users make many pairs, so tasks that follow the bytes would hold ever more of them.
    """
    users = rows.groupBy(*group).agg(F.count(F.lit(1)).cast("double").alias("users"))
    pairs = users.agg(F.coalesce(F.sum(F.col("users") * (F.col("users") - 1) / 2), F.lit(0.0))).first()[0]
    usual = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1, int(-(-pairs // pairs_per_task)), min(usual, int(-(-10 * pairs // pairs_per_task))))


def in_blocks(rows: DataFrame, group: Sequence[str], values: Sequence[str], users_per_block: int) -> DataFrame:
    """Rows with the number of blocks of their group and the block their user is hashed into."""
    sizes = rows.groupBy(*group).agg(F.ceil(F.count(F.lit(1)) / F.lit(users_per_block)).cast("int").alias("_blocks"))
    return rows.join(sizes, list(group)).select(
        *group, "event_user_id", *values, "_blocks", F.pmod(F.xxhash64("event_user_id"), F.col("_blocks")).cast("int").alias("_block")
    )


def met(
    rows: DataFrame, group: Sequence[str], values: Sequence[str], users_per_block: int, *, pairs_per_task: int = PAIRS_PER_TASK
) -> DataFrame:
    """Each unordered pair of users of a group once, user_a < user_b, with both sides' values.

    Users of a group with more than `users_per_block` of them are hashed into blocks and each pair of blocks
    is joined on its own, so a crowded group is a grid of joins of bounded size. Group sizes, one row per
    group, are joined as any other table. The joins are dealt over as many tasks as the number of pairs asks for.
    """
    tasks = tasks_for_pairs(rows, group, pairs_per_task)
    placed = in_blocks(rows, group, values, users_per_block)

    def side(suffix: str, low: Column, high: Column) -> DataFrame:
        return placed.select(
            *group,
            F.col("event_user_id").alias(f"user_{suffix}"),
            *[F.col(c).alias(f"{c}_{suffix}") for c in values],
            low.alias("_low"),
            high.alias("_high"),
        ).repartition(tasks, *group, "_low", "_high")

    left = side("1", F.col("_block"), F.explode(F.sequence("_block", F.col("_blocks") - 1)))
    right = side("2", F.explode(F.sequence(F.lit(0), "_block")), F.col("_block"))
    ordered = F.col("user_1") < F.col("user_2")
    both = left.join(right, [*group, "_low", "_high"]).filter((F.col("_low") < F.col("_high")) | ordered)

    def pick(first: str, second: str) -> Column:
        return F.when(ordered, F.col(first)).otherwise(F.col(second))

    return both.select(
        *group,
        F.least("user_1", "user_2").alias("user_a"),
        F.greatest("user_1", "user_2").alias("user_b"),
        *[pick(f"{c}_1", f"{c}_2").alias(f"{c}_a") for c in values],
        *[pick(f"{c}_2", f"{c}_1").alias(f"{c}_b") for c in values],
    )


def _pairs(page_users: DataFrame, by: Sequence[str], page: str, users_per_block: int) -> DataFrame:
    """Each unordered pair of users on a page once, with both sides' counts."""
    rows = page_users.select(
        *by, page, "event_user_id", F.col("revisions_count").alias("count"), F.col("page_namespace").alias("ns")
    )
    return met(rows, [*by, page], ["count", "ns"], users_per_block)


def mirrored(pairs: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Forward and mirrored rows of each pair, with `keep`."""

    def row(one: str, other: str) -> Column:
        return F.struct(
            F.col(f"user_{one}").alias("event_user_id"),
            F.col(f"count_{one}").alias("revisions_count"),
            F.col(f"ns_{one}").alias("page_namespace"),
            F.col(f"user_{other}").alias("event_user_id_r"),
            F.col(f"count_{other}").alias("revisions_count_r"),
            F.col(f"ns_{other}").alias("page_namespace_r"),
        )

    return pairs.select(*keep, F.inline(F.array(row("a", "b"), row("b", "a"))))


def user_interactions(
    page_users: DataFrame,
    by: Sequence[str] = (),
    *,
    page: str = "page_id",
    users_per_block: int = USERS_PER_BLOCK,
    pairs_per_task: int = PAIRS_PER_TASK,
) -> DataFrame:
    """Every ordered pair of different users on a page, with both sides' counts and namespaces.

    Users of a page are hashed into blocks and each ordered pair of blocks is a cell of a grid, joined on its own. Cells
    are dealt over as many tasks as the number of pairs asks for, and pairs leave as the join finds them: both orders
    are joined rather than mirrored, so rows of one user follow each other and no pair is shuffled or kept.
    """
    group, held = [*by, page], ["event_user_id", "revisions_count", "page_namespace"]
    tasks = tasks_for_pairs(page_users, group, pairs_per_task)
    placed = in_blocks(page_users, group, held[1:], users_per_block)
    own, every = F.col("_block"), F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))

    def side(suffix: str, low: Column, high: Column) -> DataFrame:
        return placed.select(
            *group, *[F.col(c).alias(f"{c}{suffix}") for c in held], low.alias("_low"), high.alias("_high")
        ).repartition(tasks, *group, "_low", "_high")

    both = side("", own, every).join(side("_r", every, own), [*group, "_low", "_high"])
    return both.filter(F.col("event_user_id") != F.col("event_user_id_r")).drop("_low", "_high")


def pair_counts(
    page_users: DataFrame,
    by: Sequence[str] = (),
    *,
    page: str = "page_id",
    users_per_block: int = USERS_PER_BLOCK,
) -> DataFrame:
    """One row per unordered pair (user_a < user_b): common pages, common articles, own revisions."""
    pairs = _pairs(page_users, by, page, users_per_block)
    a_article, b_article = F.col("ns_a") == 0, F.col("ns_b") == 0
    return pairs.groupBy(*by, "user_a", "user_b").agg(
        F.count(page).alias("num_common_pages"),
        F.count_if(a_article).alias("articles_a"),
        F.count_if(b_article).alias("articles_b"),
        F.sum(F.when(a_article, F.col("count_a"))).alias("revisions_a"),
        F.sum(F.when(b_article, F.col("count_b"))).alias("revisions_b"),
    )


def pair_articles(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Ordered pairs with common articles: their number and the first user's revisions on them."""
    mirrored = F.inline(
        F.array(
            F.struct(
                F.col("user_a").alias("event_user_id"),
                F.col("user_b").alias("event_user_id_r"),
                F.col("articles_a").alias("num_common_articles"),
                F.col("revisions_a").alias("num_revisions_articles"),
            ),
            F.struct(
                F.col("user_b").alias("event_user_id"),
                F.col("user_a").alias("event_user_id_r"),
                F.col("articles_b").alias("num_common_articles"),
                F.col("revisions_b").alias("num_revisions_articles"),
            ),
        )
    )
    return counts.select(*by, mirrored).filter(F.col("num_common_articles") > 0)


def pair_pages(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Ordered pairs with the number of pages of any namespace both edited."""
    mirrored = F.inline(
        F.array(
            F.struct(F.col("user_a").alias("event_user_id"), F.col("user_b").alias("event_user_id_r")),
            F.struct(F.col("user_b").alias("event_user_id"), F.col("user_a").alias("event_user_id_r")),
        )
    )
    return counts.select(*by, mirrored, "num_common_pages")


def editor_totals(page_users: DataFrame, by: Sequence[str] = (), *, page: str = "page_id") -> DataFrame:
    """Sums over all partners of a user, without forming pairs.

    A user meets `n - 1` others on a page with `n` users, so the sum over partners of common
    articles is the sum over the user's articles of n - 1; own revisions are weighted alike.
    """
    sizes = page_users.groupBy(*by, page).agg((F.count(F.lit(1)) - 1).alias("others"))
    met = page_users.filter(F.col("page_namespace") == 0).join(sizes, [*by, page]).filter(F.col("others") > 0)
    return met.groupBy(*by, "event_user_id").agg(
        F.sum("others").alias("editor_pages_total"),
        F.sum(F.col("others") * F.col("revisions_count")).alias("editor_revisions_total"),
    )


def directed_features(
    page_users: DataFrame,
    by: Sequence[str] = (),
    *,
    page: str = "page_id",
    users_per_block: int = USERS_PER_BLOCK,
) -> DataFrame:
    """Share of a user's co-editing (articles, revisions) that goes to each partner."""
    articles = pair_articles(pair_counts(page_users, by, page=page, users_per_block=users_per_block), by)
    totals = editor_totals(page_users, by, page=page)
    return articles.join(totals, [*by, "event_user_id"]).select(
        *by,
        "event_user_id",
        "event_user_id_r",
        ratio(F.col("num_common_articles"), F.col("editor_pages_total")).alias("coedit_ratio"),
        ratio(F.col("num_revisions_articles"), F.col("editor_revisions_total")).alias("coedit_revisions_ratio"),
    )


def undirected_features(
    page_users: DataFrame,
    by: Sequence[str] = (),
    *,
    page: str = "page_id",
    users_per_block: int = USERS_PER_BLOCK,
) -> DataFrame:
    """Common pages and common articles of each unordered pair that shares an article."""
    return undirected_pairs(pair_counts(page_users, by, page=page, users_per_block=users_per_block), by)


def undirected_pairs(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """`undirected_features` from pair counts."""
    return counts.filter(F.col("articles_a") > 0).select(
        *by,
        F.array("user_a", "user_b").alias("pair"),
        "num_common_pages",
        F.col("articles_a").alias("num_common_articles"),
    )


def concentration_ratios(history: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """History rows with their page's named editors, named revisions and the ratio of both."""
    per_user = (
        history.filter(F.col("event_user_id").isNotNull())
        .groupBy(*by, "page_id", "event_user_id")
        .agg(F.count(F.lit(1)).alias("held"))
    )
    per_page = per_user.groupBy(*by, "page_id").agg(
        F.count(F.lit(1)).alias("num_editors"), F.sum("held").alias("num_revisions")
    )
    per_page = per_page.withColumn("concentration_ratio", ratio(F.col("num_editors"), F.col("num_revisions")))
    return history.join(per_page, [*by, "page_id"])


def concentration_ratios_pairs(page_users: DataFrame, by: Sequence[str] = (), *, page: str = "page_id") -> DataFrame:
    """The same ratio over interaction rows, where a revision counts once per partner on the page.

    Computed from page totals: with n users on a page each count appears n - 1 times.
    """
    per_page = page_users.groupBy(*by, page).agg(
        F.count(F.lit(1)).alias("num_editors"), F.sum("revisions_count").alias("_revisions")
    )
    shared = per_page.filter(F.col("num_editors") > 1).withColumn(
        "num_revisions", F.col("_revisions") * (F.col("num_editors") - 1)
    )
    return shared.select(
        *by, page, "num_editors", "num_revisions", ratio(F.col("num_editors"), F.col("num_revisions")).alias("concentration_ratio")
    )
