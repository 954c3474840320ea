"""Samples as feature rows: roll-ups over nested features, labelled unions, keyed combination."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from revtide.functions.numbers import entropy_term
from revtide.schemas import SAMPLE_KEY


def rollup(df: DataFrame, columns: Sequence[str], by: Sequence[str] = SAMPLE_KEY, *extra) -> DataFrame:
    """mean_, std_ (sample) and max_ of each column per group; a single row has no std."""
    measures = []
    for name in columns:
        value = F.col(name).cast("double")
        measures += [
            F.avg(value).alias(f"mean_{name}"),
            F.stddev_samp(value).alias(f"std_{name}"),
            F.max(value).alias(f"max_{name}"),
        ]
    return df.groupBy(*by).agg(*measures, *extra)


def merged(moments: DataFrame, columns: Sequence[str], by: Sequence[str] = SAMPLE_KEY, *extra) -> DataFrame:
    """`rollup` from moments of parts: number n_, mean_, squared deviations dev_ and max_ of each column."""
    group = Window.partitionBy(*by)
    whole = moments.withColumns({f"_n_{c}": F.sum(f"n_{c}").over(group) for c in columns})
    whole = whole.withColumns({f"_mean_{c}": F.try_divide(F.sum(F.col(f"n_{c}") * F.col(f"mean_{c}")).over(group), F.col(f"_n_{c}")) for c in columns})
    measures = []
    for c in columns:
        apart = F.col(f"mean_{c}") - F.col(f"_mean_{c}")
        dev, others = F.sum(F.col(f"dev_{c}") + F.col(f"n_{c}") * apart * apart), F.max(f"_n_{c}") - 1
        measures += [
            F.max(f"_mean_{c}").alias(f"mean_{c}"),
            F.when(others > 0, F.sqrt(dev / others)).alias(f"std_{c}"),
            F.max(f"max_{c}").alias(f"max_{c}"),
        ]
    return whole.groupBy(*by).agg(*measures, *extra)


USER_ARTICLE = [
    "edit_size",
    "next_edit_size",
    "time_to_respond",
    "time_responded_to",
    "num_edits",
    "frac_page_edits",
    "revision_is_identity_reverted",
    "revision_is_identity_revert",
]
EDITOR = [
    "num_groups",
    "num_articles",
    "num_edits",
    "num_past_blocks",
    "num_curr_blocks",
    "num_reverts_by_others",
    "num_reverts_of_others",
    "time_since_registration",
    "talk_article_ratio",
    "contribution_frac_entropy",
]


def rollup_user_article(features: DataFrame, by: Sequence[str] = SAMPLE_KEY) -> DataFrame:
    """Roll-up plus the entropy of the editors' page shares as they are (anonymous edits count in the whole)."""
    entropy = F.sum(entropy_term(F.col("frac_page_edits"))).alias("frac_page_edits_ent")
    return rollup(features, USER_ARTICLE, by, entropy)


def rollup_language(counts: DataFrame, strategies: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Roll-up of marker counts and reply depth over all utterances of a group."""
    return rollup(counts, [*strategies, "reply_depth"], by)


def rollup_editor(features: DataFrame, by: Sequence[str] = SAMPLE_KEY) -> DataFrame:
    return rollup(features, EDITOR, by)


def rollup_collab(directed: DataFrame, undirected: DataFrame, by: Sequence[str] = SAMPLE_KEY) -> DataFrame:
    """Roll-up of directed and undirected pair features; groups without an undirected pair have no row."""
    left = rollup(undirected, ["num_common_pages", "num_common_articles"], by)
    right = rollup(directed, ["coedit_ratio", "coedit_revisions_ratio"], by)
    return left.join(right, list(by), "left")


def labelled_union(negative: DataFrame, positive: DataFrame) -> DataFrame:
    """Both classes in one frame with a 0/1 label; columns missing on one side become NULL."""
    return negative.withColumn("label", F.lit(0)).unionByName(
        positive.withColumn("label", F.lit(1)), allowMissingColumns=True
    )


def combine(samples: DataFrame, blocks: Mapping[str, DataFrame], by: Sequence[str] = SAMPLE_KEY) -> DataFrame:
    """Feature blocks side by side, joined on the sample key, columns prefixed by their block."""

    def attach(left: DataFrame, item) -> DataFrame:
        name, block = item
        renamed = block.select(*by, *[F.col(c).alias(f"{name}_{c}") for c in block.columns if c not in by])
        return left.join(renamed, list(by), "left")

    return reduce(attach, blocks.items(), samples)
